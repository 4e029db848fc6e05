"""Operator 10: exact n-gram Jaccard join with set-relation skipping.

A document's set is that of its distinct word shingles. Documents with equal
sets are one class; classes are linked if 100 * intersection >= percent * union.

Two sets that similar share one of their first |x| - ceil(percent |x| / 100) + 1
shingles in any common order. Here the order is by hash, behind which come
shingles that many documents have (counted over all documents in a sketch of
fixed size, which decides order and cost, never results). Index lists hold these
shingles with set size and position:

* lists are read in blocks by size, and pairs are skipped whose sizes or
  positions leave too little room for the overlap;
* a list's sets are first measured against one hub set; sets that are then in
  one component need no more. For two sets that resemble a hub the answer is
  derived from how each differs from it; for others the overlaps with the hub
  bound theirs. Only what these leave open is measured.

Everything that is measured is measured on the words themselves.

Defined results: null text and texts without words have the empty set and no
link, component_id is their own doc_id; rows are classed by their text, so
repeated rows and repeated doc_ids with other texts are separate rows of the
result, and component_id is the smallest doc_id among the rows of a component
(null ids only if there is no other); an empty table gives an empty result;
other columns are ignored, or carried along by one_of_each_group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import forget, free_caches, near_ids, numbered, over_batches, prepare, table, texts_as_bytes

N_GRAM, PERCENT = 4, 85
#: Share of the documents from which on a shingle counts as frequent.
FREQUENT = 0.0002
_SIGNATURE = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SETS = "rid long, doc_id {id}, h long, n long, digest binary, signature binary, keys binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingles(text: bytes, n: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(w) - n + 1
    h = w[:last].copy()
    for i in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[i : last + i]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(30)))


def exact_set(text: bytes, n: int) -> set:
    words = words_of(text)
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else {tuple(words)}


def frequent_slots(docs: DataFrame, n: int) -> np.ndarray:
    """Which counters of the sketch hold a shingle that more than FREQUENT of the documents have."""
    counts, rows = linking.counters(docs.select("text"), lambda batch: np.concatenate([shingles(text, n) for text in texts_as_bytes(batch.column(0))]))
    usual = float(np.median(counts))
    return counts > usual + max(2.0, FREQUENT * rows, 6 * usual**0.5)


def sets(docs: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame:
    """A row for each document: set size, digest, signature (an upper bound of overlaps) and the shingles that index it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, digest, signature, keys = [], [], [], []
        for text in texts_as_bytes(batch.column(3)):
            s = shingles(text, n)
            size.append(len(s))
            if not len(s):
                digest.append(None), signature.append(None), keys.append(None)
                continue
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            parts = np.bincount((s & np.uint64(_SIGNATURE - 1)).astype(np.int64), minlength=_SIGNATURE)
            signature.append(parts.astype(np.uint8).tobytes() if parts.max() < 256 else None)
            often = frequent[linking.slot(s)]
            first = len(s) - -(-percent * len(s) // 100) + 1
            keys.append(np.concatenate([s[~often][:first], s[often][: max(0, first - int((~often).sum()))]]).tobytes())
        more = [pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()), pa.array(keys, pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *more], names=["rid", "doc_id", "h", "n", "digest", "signature", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("h"), "text")
    return table(over_batches(rows, run, _SETS.format(id=kind)), "sets")


def postings(of: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [np.frombuffer(k, np.int64) for k in batch.column(2).to_pylist()]
        n = np.array([len(k) for k in keys])
        ids, size = (np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1))
        pos = np.concatenate([np.arange(k) for k in n])
        return linking.batch_stars(np.concatenate(keys), ids, size, pos)

    return over_batches(of.select("rid", "n", "keys"), run, linking.POSTING)


def texts_of(docs: DataFrame, uses: DataFrame) -> DataFrame:
    """a, part, b, text for each of uses (a, part, b, doc_id, h): a row's text, which of repeated rows one has."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one key, in which nulls are equal, of one type on both sides: what is dealt by it serves the distinct and the join, so texts move once
    key = F.struct("doc_id", "h").cast(f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},h:bigint>").alias("k")
    near = near_ids(docs.select("doc_id", "text"), uses).withColumn("h", F.xxhash64("text")).select(key, "text")
    return near.repartition(n, "k").dropDuplicates(["k"]).join(uses.select("a", "part", "b", key).repartition(n, "k"), "k").select("a", "part", "b", "text")


def component_rows(docs: DataFrame, n: int = N_GRAM, percent: int = PERCENT) -> DataFrame:
    """rid, doc_id, h, n, component_id and lead (the rid of the component's row that has that id) for every row."""
    prepare(docs.sparkSession)
    w = sets(docs, frequent_slots(docs, n), n, percent)
    # one class for each set: its first row stands for it
    classes = table(w.where("n > 0").groupBy("digest").agg(F.min("rid").alias("rid"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", F.col("rid").alias("lead"))).alias("least"), F.count("*").alias("copies")), "classes")
    # copies are known by key only among rows that share a slot with one: index lists do not move for it
    again = classes.where("copies > 1").select("digest", F.col("rid").alias("first"))
    copies = table(w.where("n > 0").select("rid", "digest").join(again, "digest").where("rid <> first").select("rid"), "copies")
    listed = w.where("n > 0").select("rid", "n", "keys")
    reps = near_ids(listed, copies, inside=False, on="rid").unionByName(near_ids(listed, copies, on="rid").join(copies, "rid", "left_anti"))
    met = table(linking.groups(postings(reps)), "groups")
    # no later step reads the index lists of the sets
    whole, w = w, table(w.drop("keys"), "sets")
    forget(whole)
    sized = w.select("rid", "n", "signature")
    where_ = w.select("rid", "doc_id", "h")

    def bounded(batch: pa.RecordBatch, bar: int) -> pa.RecordBatch:
        """The pairs with a bound of their overlap by signatures, and whether it leaves a similarity of bar percent open."""
        a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
        bound, ok = [], []
        for x, y, s, t in zip(na.to_pylist(), nb.to_pylist(), sa.to_pylist(), sb.to_pylist(), strict=True):
            most = min(x, y) if s is None or t is None else int(np.minimum(np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)).sum(dtype=np.int64))
            bound.append(most)
            ok.append((100 + bar) * most >= bar * (x + y))
        return pa.RecordBatch.from_arrays([a, b, na, nb, pa.array(bound, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "na", "nb", "most", "open"])

    def code(shingle: tuple[bytes, ...]) -> int:
        return xxhash.xxh3_64_intdigest(b" ".join(shingle))

    def measure(pairs: DataFrame, diffs: bool) -> DataFrame:
        def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free_caches()
            mine: set = set()
            for batch in batches:
                out = []
                for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2)), strict=True):
                    if b is None:  # the hub's own row comes first
                        mine = exact_set(text, n)
                        continue
                    other = exact_set(text, n)
                    k = len(mine & other)
                    linked = 100 * k >= percent * (len(mine) + len(other) - k)
                    out.append((a, b, len(mine), len(other), k, k, linked, linking.difference(mine, other, code) if diffs else None))
                yield linking.measured_batch(out)

        side = lambda c, k: sized.select(F.col("rid").alias(c), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}"))
        open_ = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "n1", "n2", "s1", "s2")
        judged = table(over_batches(open_, lambda batch: bounded(batch, linking.NEAR if diffs else percent), "a long, b long, na long, nb long, most long, open boolean"), "pairs")
        open_ = judged.where("open").select("a", "b")
        uses = table(linking.hub_uses(open_).join(where_.withColumnRenamed("rid", "id"), "id"), "uses")
        out = linking.dealt_by_hub(texts_of(docs, uses)).mapInArrow(overlap, linking.MEASURED)
        if diffs:
            out = out.unionByName(judged.where("not open").select("a", "b", "na", "nb", F.lit(0).cast("long").alias("least"), "most", F.lit(False).alias("linked"), F.lit(None).cast("binary").alias("diff")))
        out = table(out, "measured")
        for done in (uses, judged):
            forget(done)
        return out

    _, labels = linking.link(met, measure, percent)
    # classes that are alone and have no copies keep their own id: only the others are joined to the rows
    marked = classes.join(labels.withColumnRenamed("id", "rid"), "rid", "left").where("root is not null or copies > 1").select("digest", "least", F.coalesce("root", "rid").alias("root"))
    least = marked.groupBy("root").agg(F.min("least").alias("least"))
    of = marked.select("digest", "root").join(least, "root").select("digest", F.col("least.doc_id").alias("c"), F.col("least.lead").alias("lead"), F.lit(True).alias("hit"))
    # empty sets meet nothing: their null digests stay out of the join
    own = ["rid", "doc_id", "h", "n"]
    out = w.where("n > 0").select(*own, "digest").join(of, "digest", "left").select(*own, F.when(F.col("hit"), F.col("c")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("lead", "rid").alias("lead"))
    return out.unionByName(w.where("n = 0").select(*own, F.col("doc_id").alias("component_id"), F.col("rid").alias("lead")))


def join_documents(docs: DataFrame, n: int = N_GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return component_rows(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id.

    Five words and a similarity of 0.8, as near duplicates take. Rows that share
    no slot with a dropped one are passed on where they lie.
    """
    rows = component_rows(docs, n, percent)
    keys = rows.groupBy("doc_id", "h").agg(F.max(F.col("rid") == F.col("lead")).alias("keep"), F.count("*").alias("copies"))
    odd = table(keys.where("not keep or copies > 1"), "dropped").select(F.col("doc_id").alias("odd_id"), F.col("h").alias("odd_h"), "keep")
    plain, names = numbered(docs)
    at, ids = names["doc_id"], odd.select(F.col("odd_id").alias(names["doc_id"]))
    touched = near_ids(plain, ids, on=at).withColumn("own_h", F.xxhash64(names["text"])).join(odd, F.col(at).eqNullSafe(F.col("odd_id")) & (F.col("own_h") == F.col("odd_h")), "left")
    alone = touched.where("keep is null").select(*plain.columns)
    first = touched.where("keep").dropDuplicates(["odd_id", "odd_h"]).select(*plain.columns)
    return near_ids(plain, ids, inside=False, on=at).unionByName(alone).unionByName(first).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return join_documents(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 4)
  UNION ALL
  SELECT r, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
k AS (SELECT r, any_value(n) AS n, list_sort(list(s)) AS whole FROM g JOIN n USING (r) GROUP BY r),
c AS (SELECT whole, min(r) AS c, any_value(n) AS n FROM k GROUP BY whole),
m AS (SELECT k.r, c.c FROM k JOIN c USING (whole)),
p AS (
  SELECT x.r AS a, y.r AS b, count(*) AS shared
  FROM g x JOIN g y ON x.s = y.s AND x.r < y.r
  WHERE x.r IN (SELECT c FROM c) AND y.r IN (SELECT c FROM c)
  GROUP BY x.r, y.r),
e AS (
  SELECT a, b FROM p JOIN n x ON a = x.r JOIN n y ON b = y.r
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (
  SELECT c, c FROM c
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (SELECT c, min(doc_id) AS doc_id FROM m JOIN d USING (r) GROUP BY c),
root AS (SELECT reach.a AS c, min(least.doc_id) AS component_id FROM reach JOIN least ON reach.b = least.c GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r) LEFT JOIN root ON root.c = m.c
"""
