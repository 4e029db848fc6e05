"""Links between similar sets and their components, for operators that index sets by keys.

Two sets that are similar share a key. Within the sets of a key not all pairs
are written out:

1. Each key's sets are linked to one hub as a star; in front of the exchange
   each batch does that for its own sets first, so a key of many sets sends one
   row from each batch. Star pairs that filters do not rule out are verified.
2. Verified links give components. A key whose sets are all in one component is
   done. In the others, pairs between components remain. If both sets resemble a
   common hub, their overlap follows from how each differs from it, so they are
   looked for in an index of these differences. For others, the known overlaps
   with the hub and the key's positions rule out most, whole blocks of a key's
   sets at once; the rest is verified.

Both steps together decide every pair that shares a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, free_caches, over_batches, shuffles_go, table

#: key; set id; its size and the key's position in it; hub; whether the set alone of its batch stands for a key that has more
POSTING = "key long, id long, size int, pos int, hub long, hub_size int, hub_pos int, more boolean"
_NAMES = [x.split()[0] for x in POSTING.split(", ")]
#: Sets of a key that are compared with each other at a time; hubs that a key's sets are compared with, one after
#: another (more than one saves pairs only where keys join several large groups).
BLOCK, HUBS = 512, 1
#: Sets of a key that one task compares with each other; a key of more is cut into parts of about that many.
CELL = 4096
#: Edges that one task joins at the end of components.
FINISH = 1 << 14
#: Pairs of a hub that one task measures.
HUB_PAIRS = 1024
#: Counters of the sketch that finds frequent shingles, and the slices in which it moves.
COUNTERS, _SLICES = 1 << 19, 64
#: Similarity in percent from which a set is described by its difference from a hub.
NEAR = 70


def batch_stars(key: np.ndarray, ids: np.ndarray, size: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Postings of a batch with the first set of each key as the hub of the others there."""
    order = np.lexsort((ids, key))
    key, ids, size, pos = key[order], ids[order], size[order], pos[order]
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    n = np.diff(np.r_[start, len(key)])
    head = np.repeat(start, n)
    more = np.repeat(n > 1, n) & first
    arrays = [key, ids, size.astype(np.int32), pos.astype(np.int32), ids[head], size[head].astype(np.int32), pos[head].astype(np.int32), more]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=_NAMES)


def groups(postings: DataFrame) -> DataFrame:
    """Of keys with two sets or more, each set and its hub: the batch's, or for batch hubs (`more`) the key's."""
    # rows that have their hub in their batch go anywhere; the others meet by key
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(n, "key", F.when(F.col("id") != F.col("hub"), F.col("id"))).sortWithinPartitions("key", "id")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        hub = None  # (key, id, size, pos) of the run's first row; `waiting`: not yet given out
        waiting: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(_NAMES)}
            own = c["id"] == c["hub"]
            at = np.flatnonzero(own)
            key = c["key"][at]
            out = {name: v.copy() for name, v in c.items()}
            give = ~own | c["more"]
            if len(at):
                first = np.r_[hub is None or key[0] != hub[0], key[1:] != key[:-1]]
                n = np.diff(np.r_[np.flatnonzero(first), len(at)])
                head = np.zeros(len(at), np.int64)
                lead = len(at) if not first.any() else int(np.flatnonzero(first)[0])
                head[lead:] = np.repeat(at[first], n)
                for name, source, k in (("hub", "id", 1), ("hub_size", "size", 2), ("hub_pos", "pos", 3)):
                    v = c[source][head]
                    if lead:
                        v[:lead] = hub[k]
                    out[name][at] = v
                follows = ~first
                give[at[follows]] = True
                give[at[:-1][follows[1:]]] = True
                if lead and waiting is not None:
                    yield waiting.set_column(len(_NAMES) - 1, _NAMES[-1], pa.array([True]))
                last = at[-1]
                waiting = None
                if lead < len(at):
                    h = at[first][-1]
                    hub = tuple(c[x][h].item() for x in ("key", "id", "size", "pos"))
                    if not give[last]:  # alone so far
                        waiting = batch.slice(int(last), 1)
            out["more"] = own
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(out[x][give]) for x in _NAMES], names=_NAMES)

    return dealt.mapInArrow(stars, POSTING)


MEASURED = "a long, b long, na long, nb long, least long, most long, linked boolean, diff binary"


def measured_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in MEASURED.split(", ")])


def union_of(*parts: DataFrame) -> DataFrame:
    """One scan over several written tables of one schema."""
    paths = [p for df in parts for p in df._lattica_paths]
    out = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths)
    out._lattica_paths = paths
    return out


def counters(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, int]:
    """A sketch of COUNTERS counters of 64-bit hashes, by their high bits, and the number of rows.

    Each task sends its counters in slices; a slice is added up as it streams by, so
    neither a task nor the driver ever holds more than the sketch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        total, n = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(slot(hashes(batch)), minlength=COUNTERS)
                n += batch.num_rows
        if n:
            yield _slices(range(_SLICES), total.reshape(_SLICES, -1), n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, n = None, np.zeros(COUNTERS // _SLICES, np.int64), 0
        for batch in batches:
            for k, rows_, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at is not None and k != at:
                    yield _slices([at], total[None], n)
                    total, n = np.zeros_like(total), 0
                at, n = k, n + rows_
                total += np.frombuffer(blob, np.int64)
        if at is not None:
            yield _slices([at], total[None], n)

    kind = "slice int, rows long, counts binary"
    with shuffles_go(rows.sparkSession):
        got = rows.mapInArrow(count, kind).repartition(_SLICES, "slice").sortWithinPartitions("slice").mapInArrow(add, kind).collect()  # COUNTERS counters
    if not got:
        return np.zeros(COUNTERS, np.int64), 0
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(got, key=lambda r: r["slice"])]), got[0]["rows"]


def _slices(numbers, counts: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([n] * len(counts), pa.int64()), pa.array([c.tobytes() for c in counts], pa.binary())], names=["slice", "rows", "counts"])


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def hub_uses(pairs: DataFrame) -> DataFrame:
    """a, part, b, id: the id whose text stands where pairs (a, b) are measured, b null for the hub a itself.

    A hub is there once, or if it has many pairs once for each HUB_PAIRS of them, in as many tasks.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    hubs = load.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("id"))
    rest = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", F.col("b").alias("id"))
    return hubs.unionByName(rest)


def dealt_by_hub(used: DataFrame) -> DataFrame:
    """(a, b, text) of rows a, part, b, text, dealt by a and part; the hub's own row, with b null, comes before its pairs."""
    n = int(used.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return used.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text")


def beside_hub(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text of b) of pairs (a, b) and texts (id, text), the text of a with b null before them, as dealt_by_hub says."""
    return dealt_by_hub(hub_uses(pairs).join(texts.select("id", "text"), "id"))


def one_label(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> bool:
    """Whether two blocks hold sets of one label only."""
    return x["label"].min() == x["label"].max() == y["label"].min() == y["label"].max()


def cross_pairs(rows: DataFrame, columns: list[str], open_: Callable, closed: Callable, thin: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of ids of one key, a < b, for which open_(x, y) holds.

    columns: key, id, size, pos, label and what open_ looks at, all numbers; pairs of
    one label are not open. A key's sets lie in blocks by size and position, and
    closed(x, y), which sees two blocks whole, skips pairs of blocks. A key of more
    than CELL sets is cut into parts, and each two parts meet in a cell of their own,
    so a task holds two parts at a time. thin: of all pairs between two labels in a
    pair of blocks one is enough.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = rows.groupBy("key").agg(F.count("*").alias("sets"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    many = many.select("key", F.ceil(F.col("sets") / CELL).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j")))
    dealt = rows.select(*columns).join(many, "key").withColumn("part", part).select(*columns, "part", F.explode(cells).alias("c")).select(*columns, "part", F.col("c.i").alias("i"), F.col("c.j").alias("j"))
    dealt = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    names = [*columns, "part", "i", "j"]

    def blocks(run: dict[str, np.ndarray], part: int) -> list[dict[str, np.ndarray]]:
        at = np.flatnonzero(run["part"] == part)
        order = at[np.lexsort((run["id"][at], run["pos"][at], (8 * np.log(run["size"][at] + 1.0)).astype(np.int64)))]
        return [{k: v[order[i : i + BLOCK]] for k, v in run.items()} for i in range(0, len(order), BLOCK)]

    def open_pairs(run: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        i, j = int(run["i"][0]), int(run["j"][0])
        xs = blocks(run, i)
        ys = xs if i == j else blocks(run, j)
        for k, x in enumerate(xs):
            for y in ys[k:] if i == j else ys:
                if one_label(x, y) or closed(x, y):
                    continue
                ok = open_({c: v[:, None] for c, v in x.items()}, {c: v[None, :] for c, v in y.items()})
                if x is y:
                    ok = np.triu(ok, 1)
                p, q = np.nonzero(ok)
                if len(p):
                    a, b = x["id"][p], y["id"][q]
                    if thin:
                        first = np.unique(np.sort(np.stack([x["label"][p], y["label"][q]], axis=1), axis=1), axis=0, return_index=True)[1]
                        a, b = a[first], b[first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(names)}
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            new = np.zeros(len(c["key"]), bool)
            for k in ("key", "i", "j"):
                new[1:] |= c[k][1:] != c[k][:-1]
            start = np.flatnonzero(np.r_[True, new[1:]])
            # runs whose sets all have one label have no open pair
            mixed = np.minimum.reduceat(c["label"], start) != np.maximum.reduceat(c["label"], start)
            for k in np.flatnonzero(mixed[:-1]):
                yield from open_pairs({name: v[start[k] : start[k + 1]] for name, v in c.items()})
            held = {name: v[start[-1] :] for name, v in c.items()}
        if held is not None:
            yield from open_pairs(held)

    return dealt.mapInArrow(each, "a long, b long").distinct()


def difference(hub: set, other: set, code: Callable[[object], int], near: int = NEAR) -> bytes | None:
    """How a set differs from a hub that it has much in common with: count of additions, additions, removals, as 64-bit codes."""
    inter = len(hub & other)
    if 100 * inter < near * (len(hub) + len(other) - inter):
        return None
    more, less = (sorted(code(x) for x in s) for s in (other - hub, hub - other))
    return np.array([len(more), *more, *less], np.uint64).tobytes()


def difference_rows(measured: DataFrame, percent: int) -> DataFrame:
    """An index of the differences from common hubs: key, id, hub, size, pos, both, n, hub_n.

    For sets x and y, both compared with hub h: |x & y| = |h| - |h - x| - |h - y|
    + the overlap of their differences (additions and removals). For x, y similar
    and x not similar to h that overlap is at least
    (percent (|x| + |h|) - (100 + percent) |x & h|) / 100, so all but that many of
    x's differences, plus one, hold a shared one. Sets similar to h index all of
    theirs. The differences that the fewest sets have come first.
    """
    names = ["key", "id", "hub", "size", "both", "n", "hub_n", "least"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[np.zeros(0, np.int64)] for _ in names]
        for a, b, na, nb, linked, diff in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            codes = np.frombuffer(diff, np.uint64)[1:]
            count = len(codes)
            both = na - (count - int(np.frombuffer(diff, np.uint64)[0]))
            least = 1 if linked else max(1, -(-(percent * (nb + na) - (100 + percent) * both) // 100))
            keys = ((codes ^ np.uint64(a & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            for c, v in zip(out, (keys, *(np.full(count, x) for x in (b, a, count, both, nb, na, least))), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=names)

    rows = table(over_batches(measured.where("diff is not null").select("a", "b", "na", "nb", "linked", "diff"), run, ", ".join(f"{x} long" for x in names)), "differences")
    # what one set alone has can't be shared
    shared = rows.groupBy("key").agg(F.count("*").alias("sets"))
    rank = F.row_number().over(Window.partitionBy("hub", "id").orderBy(F.desc("sets"), "key"))
    # counted from the most frequent one, as those that are not shared come first: pos = size - rank
    placed = rows.join(shared.where("sets > 1"), "key").withColumn("pos", F.col("size") - rank)
    return placed.where("pos <= size - least").select("key", "id", "hub", "size", "pos", "both", "n", "hub_n")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges that it gets: each id and its root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "to"])


#: Columns of the index of differences that its pairs are judged by.
DIFFERENCES = ["key", "id", "size", "pos", "both", "n", "hub_n"]


def shared_enough(percent: int) -> Callable:
    """Says of two sets described from one hub whether their differences may overlap as much as they have to."""

    def open_(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
        need = -(-percent * (x["n"] + y["n"]) // (100 + percent)) + x["hub_n"] - x["both"] - y["both"]
        return (x["label"] != y["label"]) & (np.minimum(x["size"] - x["pos"], y["size"] - y["pos"]) >= need)

    return open_


def too_little(percent: int) -> Callable:
    """The same for two blocks: no pair of theirs may."""

    def closed(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> bool:
        need = -(-percent * (x["n"].min() + y["n"].min()) // (100 + percent)) + x["hub_n"].min() - x["both"].max() - y["both"].max()
        return min((x["size"] - x["pos"]).max(), (y["size"] - y["pos"]).max()) < need

    return closed


def components(edges: DataFrame) -> DataFrame:
    """id and root of every id in edges (a, b long), by contraction.

    Each round every id joins the neighbour, or itself, with the least hash for
    the round; what is left of the edges connects those. All steps are joins and
    aggregates; the tables of a round are written, as lost executors would
    otherwise repeat all rounds. Rounds shrink the graph whatever its size; once no
    more than FINISH edges are left, one task joins these.
    """
    spark = edges.sparkSession
    now = table(edges.where("a <> b").select("a", "b"), "edges")
    steps: list[DataFrame] = []
    while left := now.count():
        if left <= FINISH:
            steps.append(table(now.coalesce(1).mapInArrow(_joined, "id long, to long"), "step"))
            forget(now)
            break
        mark = lambda c: F.xxhash64(F.lit(len(steps)), c)  # noqa: B023, E731
        both = now.union(now.select("b", "a")).union(now.select("a", "a")).union(now.select("b", "b"))
        step = table(both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(mark(F.col("b")).alias("h"), F.col("b").alias("to"))).alias("m")).select("id", "m.to"), "step")
        after = now.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        after = table(after.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(now)
        now, steps = after, [*steps, step]
    if not steps:
        return spark.createDataFrame([], "id long, root long")
    roots = steps[-1].select("id", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        up = roots.select(F.col("id").alias("to"), "root")
        roots = step.join(up, "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    return roots


def apart(percent: int) -> Callable:
    """Says of two blocks that sizes or positions leave no pair of theirs room for that similarity."""

    def closed(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> bool:
        (a, b), (c, d) = ((v["size"].min(), v["size"].max()) for v in (x, y))
        if 100 * int(b) < percent * int(c) or 100 * int(d) < percent * int(a):
            return True
        room = min(int((v["size"] - v["pos"]).max()) for v in (x, y))
        return (100 + percent) * room < percent * (int(a) + int(c))

    return closed


def link(met: DataFrame, measure: Callable[[DataFrame, bool], DataFrame], percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, labels) of all sets that share a key and have that Jaccard similarity.

    met: the table of groups(postings); it is removed once it is read.
    measure(pairs, diffs) takes pairs (a, b) and returns a table (a, b, na, nb, least,
    most, linked, diff): set sizes, bounds of their overlap and the verdict; with
    diffs also difference(a's set, b's set) where there is one. It may leave out
    pairs that are not linked and, with diffs, have no difference.
    links: a, b. labels: id, root of every set that has a link.
    """
    up = 100 + percent

    def sized(n1, n2):
        return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)

    def sizes_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(sized(n1, n2)))

    # of a key's sets all have its one hub in the end
    top = met.where("more").select("key", F.col("id").alias("hub"), F.col("hub").alias("to"), F.col("hub_size").alias("to_size"))
    moved = met.where("not more").join(top, ["key", "hub"]).select("key", "id", "size", "pos", F.col("to").alias("hub1"), F.col("to_size").alias("hub_size"))
    g = table(met.where("more").select("key", "id", "size", "pos", F.col("hub").alias("hub1"), "hub_size").union(moved), "hubs")
    forget(met)
    # rounds of stars: what does not resemble a key's hub gets another one there
    measured: list[DataFrame] = []
    for t in range(1, HUBS + 1):
        before = g
        if t > 1:
            far = g.where(" and ".join(f"near{k} = 0" for k in range(1, t)))
            least = far.groupBy("key").agg(F.min(F.struct("id", "size")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", F.col("m.id").alias(f"hub{t}"), F.col("m.size").alias("hub_size"))
            g = g.drop("hub_size").join(least, "key", "left")
            g = g.withColumn(f"hub{t}", F.when(F.expr(" and ".join(f"near{k} = 0" for k in range(1, t))), F.col(f"hub{t}")))
        stars = g.where(f"id <> hub{t}").select(F.col(f"hub{t}").alias("a"), F.col("id").alias("b"), "size", "hub_size").mapInArrow(sizes_fit, "a long, b long").distinct()
        if t == 1:
            # a key of two sets has no pair besides its star
            many = g.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 2").select("key")
            g = g.join(many, "key", "left_semi")
        else:
            stars = stars.join(measured[-1].select("a", "b"), ["a", "b"], "left_anti")
        new = measure(stars, True)
        measured.append(new if t == 1 else union_of(measured[-1], new))
        known = measured[-1].select(F.col("a").alias(f"hub{t}"), F.col("b").alias("id"), F.col("least").alias(f"least{t}"), F.col("most").alias(f"most{t}"), F.col("diff").isNotNull().cast("int").alias(f"near{t}"))
        at_hub = F.col("id") == F.col(f"hub{t}")
        g = g.join(known, [f"hub{t}", "id"], "left")
        g = g.withColumn(f"least{t}", F.when(at_hub, F.col("size")).otherwise(F.coalesce(f"least{t}", F.lit(0)))).withColumn(f"most{t}", F.when(at_hub, F.col("size")).otherwise(F.coalesce(f"most{t}", "size"))).withColumn(f"near{t}", F.when(at_hub, 1).otherwise(F.coalesce(f"near{t}", F.lit(0)))).withColumn(f"hub{t}", F.coalesce(f"hub{t}", F.lit(-1)))
        g = table(g, "hubs")
        forget(before)
    first = measured[-1]
    one = first.where("linked").select("a", "b")
    labels = table(components(one), "labels")
    label = lambda df: df.join(labels.select("id", F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))

    # what is left by differences from a common hub: stars again, then pairs between what is still apart
    by_hub = first.where("diff is not null").groupBy("a").agg(F.min("linked").alias("all")).where("not all").select("a")
    rows = table(difference_rows(first.join(by_hub, "a", "left_semi"), percent), "difference_keys")
    least = label(rows).groupBy("key").agg(F.min(F.struct("id", "label", "size", "pos", "both", "n")).alias("m"))
    need = F.ceil(percent * (F.col("n") + F.col("m.n")) / up) + F.col("hub_n") - F.col("both") - F.col("m.both")
    open_ = (F.col("label") != F.col("m.label")) & (F.least(F.col("size") - F.col("pos"), F.col("m.size") - F.col("m.pos")) >= need)
    again = measure(label(rows).join(least, "key").where(open_).select(F.col("m.id").alias("a"), F.col("id").alias("b")).distinct(), False)
    one = table(one.union(again.where("linked").select("a", "b")), "star_links")
    labels = table(components(one), "labels")

    near = cross_pairs(label(rows), [*DIFFERENCES, "label"], shared_enough(percent), too_little(percent))

    # what is left by keys: sets that are not both known to resemble one hub
    marked = label(g)
    split = marked.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("n > 2 and lo <> hi").select("key")
    rows = marked.join(split, "key")
    by_round = [f"{c}{t}" for t in range(1, HUBS + 1) for c in ("hub", "least", "most", "near")]

    def undecided(x, y):
        n1, n2 = x["size"].astype(np.int64), y["size"].astype(np.int64)
        # a pair is looked at where its first shared key is: nothing before it counts
        room = np.minimum(n1 - x["pos"], n2 - y["pos"])
        open_ = x["label"] != y["label"]
        for t in range(1, HUBS + 1):
            same = (x[f"hub{t}"] == y[f"hub{t}"]) & (x[f"hub{t}"] >= 0)
            bound = np.minimum(x[f"most{t}"], y[f"most{t}"]) + np.minimum(n1 - x[f"least{t}"], n2 - y[f"least{t}"])
            room = np.where(same, np.minimum(room, bound), room)
            # settled by differences, or measured as a star
            open_ = open_ & ~(same & ((x[f"near{t}"] == 1) & (y[f"near{t}"] == 1) | (x["id"] == y[f"hub{t}"]) | (y["id"] == x[f"hub{t}"])))
        return open_ & sized(n1, n2) & (up * room >= percent * (n1 + n2))

    far = cross_pairs(rows, ["key", "id", "size", "pos", "label", *by_round], undecided, apart(percent))
    two = measure(near.union(far).distinct(), False).where("linked").select("a", "b")
    links = table(one.union(two).distinct(), "links")
    return links, table(components(links), "labels")
