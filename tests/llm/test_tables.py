"""Operators 2, 5, 6, 9 and 10, components, and the pipeline."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import capture_index, line_dedup, linking, ngram_join, pfair_mix, topk_blocks
from tests.llm.conftest import SF, WORDS, sentence


def union_find(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


def near_texts(seed, groups=12, copies=9, n=45):
    """Groups of copies with more and more words changed: links, near misses and chains."""
    rnd = random.Random(seed)
    out = []
    for g in range(groups):
        base = sentence(g + seed, n).split()
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 5))):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS) + "x"
            out.append(" ".join(words))
            if rnd.random() < 0.3:
                base = words
    return out


def join_brute(rows, n, percent):
    sets = [ngram_join.exact_set((t or "").encode(), n) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = union_find(len(rows), pairs)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[of[i]] = min(least.get(of[i], doc), doc)
    return sorted(((d is None, d or 0, len(s), least.get(c) if s else d) for (d, _), s, c in zip(rows, sets, of, strict=True)), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_brute_force(spark, awkward, n, percent):
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [(100 + i, t) for i, t in enumerate(near_texts(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rid", F.lit(0))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.join_documents(docs, n, percent).collect()), key=repr)
    assert got == join_brute(rows, n, percent)


def test_one_of_each_group(spark, empty):
    rows = [(i, t) for i, t in enumerate(near_texts(3))] + [(5, near_texts(3)[5]), (500, ""), (501, ""), (None, sentence(40, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    kept = ngram_join.one_of_each_group(docs, 5, 80)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in ngram_join.join_documents(docs, 5, 80).collect()}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, groups))
    assert ngram_join.one_of_each_group(empty).count() == 0 and ngram_join.join_documents(empty).count() == 0


def lines_brute(docs):
    occ = sorted(((i, no, line.strip()) for i, t in docs for no, line in enumerate(t.split("\n")) if line.strip()))
    names = list(dict.fromkeys(x for _, _, x in occ))
    sets = [line_dedup.shingle_set(x) for x in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    of, at, seen, drop = union_find(len(names), links), {x: i for i, x in enumerate(names)}, set(), defaultdict(list)
    for i, no, x in occ:
        if of[at[x]] in seen:
            drop[i].append(no)
        seen.add(of[at[x]])
    return drop


def test_lines_brute_force(spark):
    """High recall: nearly all lines of brute force, and no other."""
    rnd = random.Random(2)
    pool = near_texts(9, 30, 5, 30)
    docs = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.6 else sentence(i * 31 + k, 12) for k in range(6))) for i in range(60)]
    got = {(r.doc_id, no) for r in line_dedup.decisions(spark.createDataFrame(docs, "doc_id long, text string")).collect() for no in r.dropped}
    want = {(i, no) for i, nos in lines_brute(docs).items() for no in nos}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_lines_awkward(awkward, empty):
    out = line_dedup.decisions(awkward)
    assert out.count() == awkward.count()
    none = out.where("doc_id in (1, 2, 3)").collect()
    assert all(r.n_lines == 0 and r.dropped == [] for r in none)
    assert out.where("doc_id = 8").first().dropped == [0]  # a copy of document 7
    text = line_dedup.dedup_documents(awkward)
    assert text.columns == awkward.columns and text.where("doc_id = 8").count() == 0
    assert [r.text for r in text.where("doc_id = 10").collect()] == ["x\n" + "tail"] * 2  # rows that repeat share a verdict
    assert text.where("n_chars <> length(text)").count() == 0
    assert line_dedup.decisions(empty).count() == 0 and line_dedup.dedup_documents(empty).count() == 0


def test_short_lines_with_one_changed_character(spark):
    """Lines of 45 to 78 characters, one in the middle changed: nearly all are linked."""
    rnd = random.Random(4)
    lines = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rnd.randint(45, 78))).strip(" ").ljust(45, "e") for _ in range(200)]
    edited = [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in lines]
    docs = spark.createDataFrame(list(enumerate(lines + edited)), "doc_id long, text string")
    dropped = [r.doc_id for r in line_dedup.decisions(docs).collect() if r.dropped]
    assert min(dropped) >= 200 and len(dropped) >= 190


def test_repeated_rows_without_repeated_lines_stay(spark):
    rows = [(1, sentence(3, 30) + "\n" + sentence(8, 30)), (2, sentence(5, 30))]
    docs = spark.createDataFrame([rows[0], rows[1], rows[0], rows[0], (3, rows[1][1])], "doc_id long, text string")
    assert sorted(tuple(r) for r in line_dedup.dedup_documents(docs).collect()) == sorted([rows[0]] * 3 + [rows[1]])


def test_long_lines_are_whole(monkeypatch):
    lines = ["".join(chr(97 + (i * i) % 23) for i in range(900)), "short", "x"]
    whole = line_dedup.band_keys(lines)
    monkeypatch.setattr(line_dedup, "_PACK", 50)
    assert (line_dedup.band_keys(lines) == whole).all()


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    got = {r.id: r.root for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find(400, pairs)
    ids = sorted({x for p in pairs if p[0] != p[1] for x in p})
    assert sorted(got) == ids
    groups = lambda of: sorted(sorted(i for i in ids if of(i) == r) for r in {of(i) for i in ids})
    assert groups(lambda i: got[i]) == groups(lambda i: want[i])
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_archives_match_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS FROM '{SF}/pages.parquet'")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, capture_index.query(spark, SF).collect()), key=key) == sorted(c.sql(capture_index.ORACLE_SQL).fetchall(), key=key)


def test_archives_awkward(spark, monkeypatch):
    monkeypatch.setattr(capture_index, "BLOCK_LINES", 2)  # runs of one key then go over blocks
    rows = [(1, "http://a.b/x", "z" * 2000), (2, "http://a.b/x", "z" * 2000), (2, "http://a.b/x", "z" * 2000), (3, None, None), (None, "http://[bad", "q"), (4, "http://a.b/x", "short"), (5, "http://a.b/y", "short"), (6, "http://a.b/x", "ü" * 600)] + [(7, "http://a.b/x", f"{i}") for i in range(9)]
    pages = spark.createDataFrame([(*r, "k", 3) for r in rows], "page_id long, url string, html string, key string, file int")
    out = capture_index.read_back(pages, capture_index.archive(pages)).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert (by[1].record_type, by[1].refers_to, by[1].payload_bytes, by[1].payload) == ("revisit", 2, 2000, None)
    assert by[2].record_type == "response" and by[3].payload_bytes == 0 and by[6].payload_bytes == 1200 and by[5].record_type == "response"
    assert sorted(bytes(r.payload).decode() for r in out if r.page_id == 7) == [str(i) for i in range(9)]
    none = pages.limit(0)
    assert capture_index.read_back(none, capture_index.archive(none)).count() == 0
    assert capture_index.url_key("HTTP://User@WWW.Example.com:8080/A?b#c") == "com,example,www:8080)/A?b"
    with pytest.raises(ValueError):
        raw = bytearray(capture_index.record(1, "u", b"payload", "response", None))
        capture_index.parse(capture_index.zlib.compress(capture_index.zlib.decompress(bytes(raw), wbits=31).replace(b"payload", b"PAYLOAD"), wbits=31))


def test_pfair(spark, awkward, empty):
    for seed in range(40):
        rnd = random.Random(seed)
        blocks, weights = [rnd.randint(0, 300) for _ in range(rnd.randint(1, 9))], [rnd.random() + 0.01 for _ in range(9)]
        times = {}
        for s, phases in enumerate(pfair_mix.schedule(blocks, weights, 60)):
            ends = [*(p["first"] for p in phases[1:]), blocks[s]][: len(phases)]
            for p, end in zip(phases, ends, strict=True):
                for j in range(end - p["first"]):
                    t = p["start"] + j // p["share"] * p["period"] + p["times"][j % p["share"]]
                    assert p["start"] + j * p["period"] // p["share"] <= t < p["start"] + math.ceil((j + 1) * p["period"] / p["share"])
                    times[t] = (s, p)
        assert sorted(times) == list(range(sum(blocks)))
        done, now = defaultdict(int), None
        for t in range(sum(blocks)):
            s, p = times[t]
            if now != p["phase"]:
                now, done, start = p["phase"], defaultdict(int), t
            done[s] += 1
            assert abs(done[s] - (t + 1 - start) * p["share"] / p["period"]) < 1
    out = pfair_mix.mix(awkward, block_rows=2)
    assert out.count() == awkward.count() == out.select("__position").distinct().count()
    assert pfair_mix.mixed_documents(awkward).columns == awkward.columns and pfair_mix.mixed_documents(awkward).count() == awkward.count()
    assert pfair_mix.mix(empty).count() == 0 and pfair_mix.mixed_documents(empty).count() == 0
    with pytest.raises(ValueError):
        pfair_mix.mix(awkward, {"s1": 0})


def test_pfair_keeps_the_given_weights(spark, small):
    """Less than one block from the weights themselves, not from a rounding of them, up to the first source's end."""
    cases = [([0.9, 0.1], [9000, 1500]), ([5.0**0.5] + [1.0] * 19, [3000] + [900] * 19), ([0.0001, 1.0, 0.37], [90, 40000, 9000])]
    for weights, blocks in cases:
        exact, order = [Fraction(str(w)) for w in weights], {}
        for s, phases in enumerate(pfair_mix.schedule(blocks, weights)):
            p = phases[0]
            for j in range(phases[1]["first"] if len(phases) > 1 else blocks[s]):
                order[p["start"] + j // p["share"] * p["period"] + p["times"][j % p["share"]]] = s
        done = [0] * len(weights)
        assert sorted(order) == list(range(len(order))) and len(order) > 9000
        for t in range(len(order)):
            done[order[t]] += 1
            if t % 97 == 0 or t + 1 == len(order):
                assert all(abs(d - w / sum(exact) * (t + 1)) < 1 for d, w in zip(done, exact, strict=True))
    out = pfair_mix.mix(small, {r[0]: 0.1 + k * 0.37 for k, r in enumerate(sorted(small.select("source").distinct().collect()))}, block_rows=1).collect()
    assert sorted(r["__slot"] for r in out) == list(range(small.count()))
    assert all(r["__release"] <= r["__slot"] < r["__deadline"] for r in out)


def test_mixed_order_is_the_files_order(spark, small, tmp_path):
    pfair_mix.mixed_documents(small, partition_rows=32).write.parquet(str(tmp_path / "out"))
    want = [r.doc_id for r in pfair_mix.mix(small).orderBy("__position").collect()]
    files = sorted((tmp_path / "out").glob("part-*"))
    assert [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == want


def test_top_k_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, topk_blocks.query(spark, SF).collect())) == sorted(c.sql(topk_blocks.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("scale", [1.0, 1e16])
def test_search_is_exact_and_skips_blocks(scale):
    rng = np.random.default_rng(3)
    d = np.round(rng.normal(size=(40, 1, 6)) * 9 + rng.normal(size=(40, 16, 6))).reshape(-1, 6) * scale
    ids, rid = rng.permutation(len(d)), np.arange(len(d))
    q = rid[::37]
    row, found, score, scored = topk_blocks.search(d[q], q, d, rid, ids, 5, 16)
    for i, r in enumerate(q):
        want = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(d[r], x, strict=True)))), ids[k]) for k, x in enumerate(d) if k != r)[:5]
        assert [(-s, f) for s, f in zip(score[row == i].tolist(), found[row == i].tolist(), strict=True)] == want
    assert scored < 0.7 * len(q) * 40


def test_top_k_awkward(spark):
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (1, [1.0, 0.5, 9.0]), (2, []), (None, [0.5, 0.5]), (3, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    out = sorted((r.query_id, r.rank, repr(r.vec_id), r.score) for r in topk_blocks.top_k(df).collect())
    one = [(20, 1, "1", 5120), (20, 2, "3", 5120), (20, 3, "20", 5120), (20, 4, "None", 3072)]
    assert out == sorted(one + one)
    assert topk_blocks.top_k(df.limit(0)).count() == 0


def test_pipeline(spark, awkward, empty, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert docs.columns == before.columns
        assert docs.count() <= before.count() and docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()) == sorted(docs.select("doc_id", "ids_sha256").collect())
    for k, rows in enumerate((awkward, empty)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            rows = spark.read.parquet(str(tmp_path / f"{name}{k}"))
