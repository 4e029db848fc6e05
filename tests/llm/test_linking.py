"""Recall, growth and the split of large groups in operators 9 and 10."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import common, line_dedup, linking, ngram_join
from tests.llm.test_tables import join_brute, lines_brute, near_texts, union_find

LETTERS = "abcdefghijklmnopqrstuvwxyz      "


def text(rnd, n):
    return "".join(rnd.choice(LETTERS) for _ in range(n)).strip().ljust(n, "e")


def near_line(rnd, line, changes):
    out = list(line)
    for _ in range(changes):
        out[rnd.randrange(len(out))] = rnd.choice("0123456789")
    return "".join(out).strip()


def dropped(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id for r in line_dedup.decisions(docs).collect() if r.dropped}


def test_near_lines_alone(spark):
    """Pairs of lines that are not equal, at 0.8 to 0.95: at least 95 % of what brute force finds, and nothing else."""
    rnd = random.Random(11)
    lines = []
    for _ in range(500):
        line = text(rnd, rnd.randint(60, 300))
        lines += [line, near_line(rnd, line, max(1, len(line) * rnd.randint(8, 26) // 1000))]
    want = set()
    for i in range(0, len(lines), 2):
        x, y = (line_dedup.shingle_set(v) for v in lines[i : i + 2])
        if x != y and 100 * len(x & y) >= 80 * len(x | y):
            want.add(i + 1)
    got = dropped(spark, lines)
    assert len(want) > 300 and got <= want and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("shared", [0.55, 0.72])
def test_pairs_grow_with_the_lines(spark, monkeypatch, shared):
    """Lines with a common template at Jaccard similarities of about 0.38 and 0.54, of which none is linked: pairs are not squared."""
    measured, counts, links = line_dedup.measured, [], []

    def counted(texts, pairs, diffs=False):
        counts[-1] += pairs.count()
        out = measured(texts, pairs, diffs)
        links.append(out.where("linked").count() if diffs else out.count())
        return out

    monkeypatch.setattr(line_dedup, "measured", counted)
    for n in (200, 800):
        rnd = random.Random(n)
        template = text(rnd, int(300 * shared))
        counts.append(0)
        assert not dropped(spark, [template + text(rnd, 300 - len(template)) for _ in range(n)])
    assert counts[1] <= 5 * counts[0] + 800 and sum(links) == 0


def test_crowded_lines_match_brute_force(spark, monkeypatch):
    """Groups beyond the bounds of a batch, a band and a task, chains among them."""
    for name, value in (("LIMIT", 12), ("BATCH", 6), ("HUBS", 3)):
        monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(linking, "CELL", 16)
    monkeypatch.setattr(linking, "BLOCK", 8)
    monkeypatch.setattr(linking, "HUB_PAIRS", 4)
    rnd = random.Random(3)
    lines = []
    for _ in range(3):
        base = text(rnd, 200)
        for k in range(60):
            lines.append(near_line(rnd, base, rnd.choice((1, 2, 4, 8))))
            if k % 20 == 19:
                base = lines[-1]
    rnd.shuffle(lines)
    want = set(lines_brute(list(enumerate(lines))))
    got = dropped(spark, lines)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_ngram_join_of_large_lists(spark, monkeypatch):
    """Lists beyond a cell's bound and hubs beyond a task's: the same result."""
    for name, value in (("CELL", 8), ("BLOCK", 4), ("HUB_PAIRS", 3)):
        monkeypatch.setattr(linking, name, value)
    rows = list(enumerate(near_texts(5, 6, 14)))
    got = sorted(((False, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == join_brute(rows, 4, 85)


def test_cross_pairs(spark, monkeypatch):
    """Every open pair of a key once, whatever the cut into cells; one for each two labels if thin."""
    monkeypatch.setattr(linking, "CELL", 7)
    monkeypatch.setattr(linking, "BLOCK", 3)
    rnd = random.Random(1)
    rows = [(k, i, rnd.randint(5, 30), 0, i % 4) for k in range(3) for i in rnd.sample(range(60), 25)]
    rows = [(k, i, n, rnd.randrange(n), label) for k, i, n, _, label in rows]
    df = spark.createDataFrame(rows, "key long, id long, size long, pos long, label long")
    fits = lambda a, b: 180 * min(a[2] - a[3], b[2] - b[3]) >= 80 * (a[2] + b[2]) and 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2])
    want = {tuple(sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4] and fits(a, b)}

    def open_(x, y):
        room = (180 * x["size"].clip(max=10**9) - 180 * x["pos"]).clip(max=180 * (y["size"] - y["pos"]))
        return (x["label"] != y["label"]) & (room >= 80 * (x["size"] + y["size"])) & (100 * x["size"] >= 80 * y["size"]) & (100 * y["size"] >= 80 * x["size"])

    columns = ["key", "id", "size", "pos", "label"]
    got = [tuple(r) for r in linking.cross_pairs(df, columns, open_, linking.apart(80)).collect()]
    assert sorted(got) == sorted(want)
    label = {r[1]: r[4] for r in rows}
    few = {tuple(r) for r in linking.cross_pairs(df, columns, open_, linking.apart(80), thin=True).collect()}
    assert few <= want and {frozenset((label[a], label[b])) for a, b in few} == {frozenset((label[a], label[b])) for a, b in want}


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(linking, "FINISH", 5)
    rnd = random.Random(6)
    pairs = [(i, i + 1) for i in range(50)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(80)]
    got = defaultdict(set)
    for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect():
        got[r.root].add(r.id)
    of, want = union_find(200, pairs), defaultdict(set)
    for x in {x for p in pairs if p[0] != p[1] for x in p}:
        want[of[x]].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_counters_add_up(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 10).alias("k"))
    import numpy as np

    counts, rows = linking.counters(df, lambda batch: batch.column(0).to_numpy().astype(np.uint64) << np.uint64(60))
    assert rows == 5000 and counts.sum() == 5000 and sorted(counts[counts > 0]) == [500] * 10
    assert linking.counters(df.limit(0), lambda batch: batch.column(0).to_numpy())[1] == 0


def test_ngram_join_matches_sql(spark):
    import duckdb

    from tests.llm.conftest import SF

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, ngram_join.query(spark, SF).collect())) == sorted(c.sql(ngram_join.ORACLE_SQL).fetchall())


def test_crowded_group_in_one_task(spark, monkeypatch):
    """Near copies, of which many are just below the similarity to each other: no pairs leave the task, and none is missed."""

    def unused(*args, **kwargs):
        raise AssertionError("no index of pairs is needed for a group that one task compares")

    monkeypatch.setattr(linking, "cross_pairs", unused)
    rnd = random.Random(8)
    base = text(rnd, 220)
    lines = [near_line(rnd, base, rnd.randint(3, 8)) for _ in range(150)]
    want, got = set(lines_brute(list(enumerate(lines)))), dropped(spark, lines)
    assert want and len(got ^ want) <= 0.02 * len(want)


def test_links_of_a_group():
    """Components by the links of one group are those of all pairs; no more links than components that they join."""
    rnd = random.Random(5)
    base = text(rnd, 200)
    lines = [near_line(rnd, base, rnd.randint(2, 9)) for _ in range(60)] + [text(rnd, 150) for _ in range(20)]
    sets = [line_dedup.shingle_codes(x) for x in lines]
    label = [min(i, 3) if i < 10 else i for i in range(len(lines))]
    links = line_dedup._links_of(np.arange(len(lines)), np.array(label), sets)
    names = [line_dedup.shingle_set(x) for x in lines]
    own = [(i, label[i]) for i in range(len(lines))]
    every = [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(names[i] & names[j]) >= 80 * len(names[i] | names[j])]
    want, got = (union_find(len(lines), [*own, *e]) for e in (every, links))
    assert want == got and len(links) < len(set(label))


def test_bands_move_in_blobs(spark):
    """What meets by band is a few rows of each key range, not a row for each line and band."""
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, "\n".join(text(rnd, 40) for _ in range(20))) for i in range(200)], "doc_id long, text string").coalesce(2)
    assert line_dedup.band_rows(docs, 8).count() <= 2 * 8 * 2


def test_ngram_join_removes_its_tables(spark):
    """Texts, index lists and first groups are not kept once no later step reads them."""
    from pathlib import Path

    from lattica.llm.common import shared_root

    def kept():
        root = Path(shared_root(spark).removeprefix("file://"))
        return {p.name for p in root.iterdir() if p.name.split("-")[1] in ("texts", "ids", "groups", "sets", "hubs")}

    before = kept()
    rows = list(enumerate(near_texts(5, 6, 14)))
    ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.split("-")[1] for x in kept() - before) == ["hubs", "sets"]


def test_ngram_join_moves_texts_once(spark, monkeypatch):
    """Joins that are not broadcast deal texts by the key of their row, then to their pairs, and no third time; ids may be null."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, dealt = [], linking.dealt_by_hub

    def seen(used):
        out = dealt(used)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(linking, "dealt_by_hub", seen)
    try:
        rows = list(enumerate(near_texts(5, 6, 14)))
        rows = [(None if i % 7 == 0 else i, x) for i, x in rows] + rows[3:5] * 2
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == join_brute(rows, 4, 85)
    # one exchange for texts, one for their uses, one to the pairs; what else is shuffled is ids or slots
    assert plans and all(p.count("REPARTITION_BY_NUM") == 3 and "SortMergeJoin" in p and p.count("ENSURE_REQUIREMENTS") == p.count("Exchange hashpartitioning(lattica_slot") for p in plans)


def test_codes_kept_are_bounded():
    """By their number, not by that of the lines: long lines would otherwise fill a worker's memory."""
    rnd = np.random.default_rng(4)
    lines = ["".join(map(chr, rnd.integers(97, 123, size=300_000))) for _ in range(12)]
    codes = line_dedup.Codes()
    for _ in range(2):
        for i, line in enumerate(lines):
            assert np.array_equal(codes.of(i, line), line_dedup.shingle_codes(line))
            assert codes.size == sum(map(len, codes.by_id.values())) <= line_dedup.WHOLE


def test_near_ids_of_many_ids(spark):
    """Rows of other ids stay where they are, however many the ids are: a row in five is wanted, and no slot is full."""
    docs = spark.range(1_000_000).select((F.col("id") * 7).alias("doc_id"))
    ids = docs.where("doc_id % 5 = 0")
    near = common.near_ids(docs, ids)
    assert near.count() < 1.02 * ids.count()
    assert near.join(ids, "doc_id").count() == ids.count()
    assert near.unionByName(common.near_ids(docs, ids, inside=False)).agg(F.count("*"), F.sum("doc_id")).first() == docs.agg(F.count("*"), F.sum("doc_id")).first()
    null = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert common.near_ids(null, null.where("doc_id is null")).collect() == [(None,)]


def test_shuffle_files_go_with_their_table(spark):
    """No shuffle file is left of a written table or of counters, though its DataFrame is still there; the session's setting stays."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    def gone(before):
        return any(not (time.sleep(0.1) or files() - before) for _ in range(100))

    before, setting = files(), spark.conf.get(common._CLEANUP)
    rows = spark.range(10_000).select((F.col("id") % 97).alias("k"))
    made = rows.groupBy("k").count().join(rows.groupBy("k").agg(F.max("k").alias("m")).hint("shuffle_merge"), "k")
    out = common.table(made, "sums")
    assert gone(before) and out.count() == 97
    before = files()
    assert linking.counters(rows, lambda batch: batch.column(0).to_numpy().astype(np.uint64))[1] == 10_000
    assert gone(before) and spark.conf.get(common._CLEANUP) == setting
    assert made.count() == 97 and common.table(made, "sums").count() == 97
