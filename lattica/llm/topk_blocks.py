"""Operator 6: exact top-k search by block-at-a-time pruning.

Vectors (already whole numbers) are dealt into blocks of BLOCK consecutive
vectors, in an order that puts vectors with like signs together. A block is a
forward index (its vectors) with the largest and smallest value of each term.
For a query, the sum over its terms of weight times the block's largest value
(smallest, for negative weights) bounds every score in the block; blocks are
taken by descending bound and scored until the bound falls below the k-th score
so far. Bounds that equal it are scored too, as ties go to the smaller id.

Blocks lie in chunks. All queries first meet the chunks' bounds alone, which are
small: each query's SEEDS best blocks of the whole table are scored, and the k-th
score among them is its bar. Then a group of queries meets only the chunks that
hold a block whose bound reaches one of their bars, and in a chunk each query
takes its blocks by descending bound until they fall below its bar or, if that is
higher, its k-th score there. What leaves a chunk reaches the bar too, so results
do not grow with the number of chunks. A task has one group of queries and one
chunk: queries and vectors are both cut to bounded pieces, and no hint broadcasts
any of them.

Defined results: vectors that are null or empty, or hold null or non-finite
values, take no part; shorter vectors count as padded with zeros; a query is a
row, so another row with its id is a candidate; null ids are candidates that
lose all ties, and never queries; scores outside the range of a long are cut to
it; fewer candidates than k give all of them; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import over_batches, prepare, table

K, SCALE, QUERY_EVERY = 20, 64, 20
BLOCK, CHUNK_BLOCKS, QUERY_GROUP = 256, 64, 512
#: Blocks that are scored for a query's bar.
SEEDS = 2
_SIGNS = 24
_EXACT = float(1 << 53)
_BIG = (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """rid, vec_id, v (doubles that are whole) and a code of leading signs, of the vectors that take part."""
    # floor gives a long; larger values are whole already
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**52, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    fine = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    code = F.aggregate(F.slice("embedding", 1, _SIGNS), F.lit(0).cast("long"), lambda a, x: a * 2 + (x > 0).cast("long"))
    rows = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return table(rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), code.alias("code")), "vectors")


def _packed(rows: DataFrame, count: int, name: str) -> DataFrame:
    """Rows of (grp, n, dims, small, rid, vec_id, v, name): up to `count` vectors of a grp each, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def one() -> pa.RecordBatch:
            dims = max(len(v) for _, _, v, _ in held)
            m = np.zeros((len(held), dims))
            for r, (_, _, v, _) in enumerate(held):
                m[r, : len(v)] = v
            small = np.abs(m).max() < 32767
            ids = [_BIG if i is None else i for _, i, _, _ in held]
            out = {"grp": [held[0][3]], "n": [len(held)], "dims": [dims], "small": [bool(small)], "rid": [np.array([r for r, _, _, _ in held], np.int64).tobytes()], "vec_id": [np.array(ids, np.int64).tobytes()], "v": [m.astype(np.int16).tobytes() if small else m.tobytes()]}
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (len(held) == count or held[-1][3] != row[3]):
                    yield one()
                    held = []
                held.append(row)
        if held:
            yield one()

    packs = rows.select("rid", "vec_id", "v", "grp").mapInArrow(run, "grp long, n int, dims int, small boolean, rid binary, vec_id binary, v binary")
    return table(packs.withColumn(name, F.monotonically_increasing_id()), name)


def _matrix(v: bytes, small: bool, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(v, np.int16 if small else np.float64).reshape(n, dims)


def _exact_scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: in float32 or float64 where every sum is exact there, else with Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    if most < 1 << 24:
        return (q.astype(np.float32) @ d.T.astype(np.float32)).astype(np.int64)
    if most < _EXACT:
        return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
    to = np.vectorize(int, otypes=[object])
    exact = to(q.astype(np.float64)) @ to(d.astype(np.float64)).T
    return np.clip(exact, -(1 << 63), _BIG).astype(np.int64)


def block_bounds(d: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest value of each term in each block."""
    cuts = range(0, len(d), block)
    return tuple(np.stack([f(d[i : i + block], axis=0) for i in cuts]).astype(np.float64) for f in (np.max, np.min))


def _padded(m: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block what no score exceeds."""
    dims = max(q.shape[1], top.shape[1])
    qd = _padded(q.astype(np.float64), dims)
    bound = np.maximum(qd, 0) @ _padded(top, dims).T + np.minimum(qd, 0) @ _padded(low, dims).T
    # doubles may round the largest sums: never below the true bound
    return bound + np.abs(bound) * 1e-12


def search(q: np.ndarray, q_rid: np.ndarray, d: np.ndarray, d_rid: np.ndarray, d_id: np.ndarray, k: int = K, block: int = BLOCK, bar: np.ndarray | None = None, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, id, score) of each query's k best in a chunk, and how many (query, block) pairs were scored.

    bar: scores below it are not asked for; only: the (query, block) pairs that are.
    """
    bound = bounds(q, *block_bounds(d, block))
    dims = max(q.shape[1], d.shape[1])
    q, d = _padded(q, dims), _padded(d, dims)
    if only is not None:
        bound = np.where(only, bound, -np.inf)
    if bar is None:
        bar = np.full(len(q), -_BIG - 1, np.int64)
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), -_BIG - 1, np.int64)
    ids = np.full((len(q), k), _BIG, np.int64)
    found = np.zeros((len(q), k), bool)
    scored = 0
    active = np.arange(len(q))
    for step in range(bound.shape[1]):
        at = order[active, step]
        # the k-th so far, or the bar; not yet k: everything from the bar on is scored
        least = np.where(found[active, -1], np.maximum(best[active, -1], bar[active]), bar[active])
        active = active[(bound[active, at] >= least) & (bound[active, at] > -np.inf)]
        if not len(active):
            break
        at = order[active, step]
        for b in np.unique(at):
            rows = active[at == b]
            scored += len(rows)
            span = slice(b * block, (b + 1) * block)
            s = _exact_scores(q[rows], d[span])
            other = (q_rid[rows][:, None] != d_rid[span][None, :]) & (s >= bar[rows][:, None])
            n = s.shape[1]
            all_s = np.hstack([best[rows], s])
            all_i = np.hstack([ids[rows], np.broadcast_to(d_id[span], s.shape)])
            all_f = np.hstack([found[rows], other])
            if n > 4 * k:  # leave only those that can be among the k best, ties included
                masked = np.where(all_f, all_s, -_BIG - 1)
                bar_here = np.partition(masked, -k, axis=1)[:, -k]
                keep = all_f & (masked >= bar_here[:, None])
                width = int(keep.sum(axis=1).max())
                pick = np.argsort(~keep, axis=1, kind="stable")[:, : max(k, width)]
                all_s, all_i, all_f = (np.take_along_axis(x, pick, axis=1) for x in (all_s, all_i, all_f & keep))
            o = np.lexsort((all_i, ~all_s, ~all_f), axis=1)[:, :k]  # ~ turns the order without overflow
            best[rows], ids[rows], found[rows] = (np.take_along_axis(x, o, axis=1) for x in (all_s, all_i, all_f))
            best[rows] = np.where(found[rows], best[rows], -_BIG - 1)
    r, c = np.nonzero(found)
    return r, ids[r, c], best[r, c], scored


#: A pack of vectors as a row's columns.
_PACK = ["n", "dims", "small", "rid", "vec_id", "v"]


def _unpacked(batch: pa.RecordBatch, r: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, rids, ids) of the pack that begins at that column."""
    x = {n: batch.column(at + i)[r].as_py() for i, n in enumerate(_PACK)}
    return _matrix(x["v"], x["small"], x["n"], x["dims"]), np.frombuffer(x["rid"], np.int64), np.frombuffer(x["vec_id"], np.int64)


def _sized_bounds(blob: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, np.float64).reshape(2, -1, dims)
    return both[0], both[1]


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose id is divisible by query_every."""
    prepare(vectors.sparkSession)
    rows = quantized(vectors, scale)
    total = rows.count()
    block = BLOCK
    chunk_rows = block * CHUNK_BLOCKS
    parts = max(1, -(-total // chunk_rows))
    chunks = _packed(rows.withColumn("grp", F.lit(0).cast("long")).repartitionByRange(parts, "code", "rid").sortWithinPartitions("code", "rid"), chunk_rows, "chunk").drop("grp")

    def limits(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [np.stack(block_bounds(_unpacked(batch, r, 1)[0], block)).tobytes() for r in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(both, pa.binary())], names=["chunk", "dims", "both"])

    of_chunks = table(over_batches(chunks.select("chunk", *_PACK), limits, "chunk long, dims int, both binary"), "bounds")
    # queries are dealt into numbered groups by hash
    n_groups = max(1, -(-total // (query_every * QUERY_GROUP)))
    asked = rows.where(f"vec_id % {query_every} = 0").withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(n_groups)))
    queries = _packed(asked.repartition(n_groups, "grp").sortWithinPartitions("grp", "code"), QUERY_GROUP, "pack")
    # groups' numbers are written beside each chunk's, then packs come by group
    meet = of_chunks.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    width = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = meet.withColumnRenamed("dims", "c_dims").join(queries, "grp").select("chunk", "pack", "c_dims", "both", *_PACK).repartition(width, "chunk", "pack")

    def best_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q, rid, _ = _unpacked(batch, r, 4)
                bound = bounds(q, *_sized_bounds(batch.column(3)[r].as_py(), batch.column(2)[r].as_py()))
                at = np.argsort(-bound, axis=1, kind="stable")[:, :SEEDS]
                m = at.shape[1]
                cols = [np.full(at.size, batch.column(0)[r].as_py()), np.full(at.size, batch.column(1)[r].as_py()), np.repeat(np.arange(len(q)), m), at.ravel(), np.repeat(rid, m)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), pa.array(np.take_along_axis(bound, at, axis=1).ravel())], names=["chunk", "pack", "q", "block", "rid", "bound"])

    first = cells.mapInArrow(best_blocks, "chunk long, pack long, q long, block long, rid long, bound double")
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("bound"), "chunk", "block"))
    seeds = first.withColumn("place", place).where(F.col("place") <= SEEDS).groupBy("chunk", "pack").agg(F.collect_list(F.struct("q", "block")).alias("pairs"))
    side = lambda df, p: df.select(*(F.col(c).alias(p + c if c in _PACK else c) for c in df.columns if c != "grp"))
    q_side, d_side = side(queries, "q_"), side(chunks, "d_")
    both_sides = [*(f"q_{c}" for c in _PACK), *(f"d_{c}" for c in _PACK)]
    result = "pack long, q long, rid long, query_id long, vec_id long, score long"

    def scored(cell: pa.RecordBatch, r: int, bar: np.ndarray | None, pairs: list | None) -> pa.RecordBatch:
        pack = cell.column(0)[r].as_py()
        q, q_rid, q_id = _unpacked(cell, r, 2)
        d, d_rid, d_id = _unpacked(cell, r, 2 + len(_PACK))
        only = None
        if pairs is not None:
            only = np.zeros((len(q), -(-len(d) // block)), bool)
            for p in pairs:
                only[p["q"], p["block"]] = True
        at, ids, scores, _ = search(q, q_rid, d, d_rid, d_id, k, block, bar, only)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pack, np.int64)), pa.array(at.astype(np.int64)), pa.array(q_rid[at]), pa.array(q_id[at]), pa.array(ids), pa.array(scores)], names=["pack", "q", "rid", "query_id", "vec_id", "score"])

    def score_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield scored(batch, r, None, batch.column(1)[r].as_py())

    seeded = seeds.join(q_side, "pack").join(d_side, "chunk").select("pack", "pairs", *both_sides).mapInArrow(score_seeds, result)
    # _BIG stands for a null id; equal rows of a tie are interchangeable
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    bars = seeded.withColumn("rank", rank).where(F.col("rank") == k).groupBy("pack").agg(F.collect_list(F.struct("q", "score")).alias("bars"))
    bars = table(bars, "bars")  # a row for each pack

    def bar_of(n: int, found: list | None) -> np.ndarray:
        bar = np.full(n, -_BIG - 1, np.int64)
        for x in found or []:
            bar[x["q"]] = x["score"]
        return bar

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in range(batch.num_rows):
                q, _, _ = _unpacked(batch, r, 4)
                bound = bounds(q, *_sized_bounds(batch.column(3)[r].as_py(), batch.column(2)[r].as_py()))
                keep.append(bool((bound >= bar_of(len(q), batch.column(4 + len(_PACK))[r].as_py())[:, None]).any()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["chunk", "pack"]).filter(pa.array(keep, pa.bool_()))

    open_ = cells.join(bars, "pack", "left").select("chunk", "pack", "c_dims", "both", *_PACK, "bars").mapInArrow(reached, "chunk long, pack long")

    def score_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield scored(batch, r, bar_of(batch.column(2)[r].as_py(), batch.column(1)[r].as_py()), None)

    found = open_.repartition(width, "chunk", "pack").join(bars, "pack", "left").join(q_side, "pack").join(d_side, "chunk").select("pack", "bars", *both_sides).mapInArrow(score_open, result)
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != _BIG, F.col("vec_id")).alias("vec_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    import os

    return top_k(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.r AS r, q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.r <> d.r
  WHERE q.vec_id % 20 = 0),
k AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""
