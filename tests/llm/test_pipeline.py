"""The pipeline's stages against brute force, one after another; awkward rows and column names; stages put together."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import bpe_automaton, line_dedup, ngram_join, pfair_mix
from tests.llm.conftest import SF
from tests.llm.test_tables import join_brute, union_find

STAGES = dict(corpus_pipeline.STAGES)


def clean(text):
    """The rules, plainly."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(covered) > 20 * len(words):
        return False
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
    small = len(re.findall("[a-z]", text))
    shouting = len(re.findall("[A-Z]", text)) > small if text.isascii() else 2 * upper > letters
    return not (10 * symbols > chars or 10 * (len(lines) - len(set(lines))) > 6 * len(lines) or not 2 * len(words) <= chars <= 20 * len(words) or shouting or (len(words) >= 50 and 20 * len(set(words)) < len(words)))


def without_similar_lines(rows):
    """Texts by doc_id after line dedup, comparing all lines with all."""
    occurrences = sorted((i, no, x.strip()) for i, t in rows for no, x in enumerate(t.split("\n")) if x.strip())
    names = list(dict.fromkeys(x for _, _, x in occurrences))
    sets = [line_dedup.shingle_set(x) for x in names]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                links.append((i, j))
    of, at, seen, drop = union_find(len(names), links), {x: i for i, x in enumerate(names)}, set(), {}
    for i, no, x in occurrences:
        if of[at[x]] in seen:
            drop.setdefault(i, set()).add(no)
        seen.add(of[at[x]])
    out = {}
    for i, t in rows:
        lines = t.split("\n")
        if i not in drop or sum(bool(x.strip()) for x in lines) > len(drop[i]):
            out[i] = "\n".join(x for no, x in enumerate(lines) if no not in drop.get(i, ()))
    return out


def test_stages_match_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, rows = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        assert len({i for i, _ in before}) == len(before)
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            assert sorted((r.doc_id, r.text) for r in rows.values()) == [(i, t) for i, t in before if clean(t)]
        elif name == "line_dedup":
            want = without_similar_lines(before)
            assert sum(want.get(i) != (rows[i].text if i in rows else None) for i, _ in before) <= 0.03 * len(before)
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "ngram_jaccard_join":
            assert sorted(rows) == sorted({least for _, _, _, least in join_brute([(i, t) for i, t in before], 5, 80)})
        elif name == "mix_sources":
            assert sorted((r.doc_id, r.text) for r in rows.values()) == before
    theirs = Tokenizer.from_file(bpe_automaton.default_path())
    theirs.no_truncation()
    theirs.no_padding()
    for i, text in before:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert rows[i].token_ids == ids and rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


ODD = ("a.b", "lattica_slot", "__slot", "__bucket", "bucket", "c0", "own_h", "h", "rid", "keep", "dropped", "position", "gone_id")


def test_stages_carry_any_column(spark, awkward, empty):
    """Names with dots and the names of helpers are carried along with their values."""
    odd = awkward.select("*", *(F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for k, c in enumerate(ODD)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        for r in out.collect():
            assert [r[c] for c in ODD] == [f"{k}:{'-' if r.doc_id is None else r.doc_id}" for k in range(len(ODD))], name
    assert STAGES["bpe_encode"](spark, odd, SF).count() == awkward.count()


def test_awkward_rows_by_stage(spark, awkward, empty):
    key = lambda rows: sorted(repr((r.doc_id, r.text)) for r in rows)
    every = awkward.collect()
    assert key(STAGES["quality_rules"](spark, awkward, SF).collect()) == key(r for r in every if clean(r.text))
    lines = STAGES["line_dedup"](spark, awkward, SF).collect()
    assert {r.doc_id for r in lines} == {r.doc_id for r in every} - {8} and sum(r.doc_id is None for r in lines) == 2  # 8 is a copy of 7
    joined = STAGES["ngram_jaccard_join"](spark, awkward, SF).collect()
    assert sum(r.doc_id == 10 for r in joined) == 1 and not any(r.doc_id == 8 for r in joined)
    assert sum(r.doc_id is None for r in joined) == 2  # a null id, and an empty text that is linked with nothing
    assert key(STAGES["mix_sources"](spark, awkward, SF).collect()) == key(every)
    encoded = STAGES["bpe_encode"](spark, awkward, SF).collect()
    assert len(encoded) == len(every) and all(r.n_tokens == len(r.token_ids) for r in encoded)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_stages_without_writing_between(spark):
    """A stage's result that has not been written is the next one's input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    got = out.select("doc_id", "ids_sha256").collect()  # before other stages begin, as the last result is not handed on
    assert sorted(got) == sorted(corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect())


def naive_schedule(blocks, weights):
    """Times, releases and deadlines of all blocks by looking at every source at every step, with fractions."""
    left, taken, out, start = dict(enumerate(blocks)), [0] * len(blocks), {}, 0
    left = {i: n for i, n in left.items() if n}
    while left:
        total = sum(weights[i] for i in left)
        share, done, now = {i: weights[i] / total for i in left}, dict.fromkeys(left, 0), 0
        while min(left.values()) > 0:
            window = {i: ((done[i] / share[i]).__floor__(), -((-(done[i] + 1) / share[i]).__floor__())) for i in left}
            i = min((i for i in left if window[i][0] <= now), key=lambda i: (window[i][1], i))
            out[i, taken[i]] = (start + now, start + window[i][0], start + window[i][1])
            done[i], taken[i], left[i], now = done[i] + 1, taken[i] + 1, left[i] - 1, now + 1
        start, left = start + now, {i: n for i, n in left.items() if n}
    return out


@pytest.mark.parametrize("weights", [{"web": 0.5, "books": 0.3}, None])
def test_mix_row_by_row(spark, small, weights):
    """Each row's slot, release and deadline against the naive schedule; its number within the source by sorting all of them."""
    block_rows, total = 3, small.count()
    buckets = max(1, -(-total // pfair_mix.BUCKET_ROWS))
    hashed = small.select("doc_id", "source", F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "text"), F.lit(buckets)).alias("b"), F.xxhash64(F.lit("mix"), "doc_id", "text").alias("o"), F.xxhash64("text").alias("t")).collect()
    of = {}
    for r in hashed:
        of.setdefault(r.source, []).append((r.b, r.o, r.doc_id, r.t))
    sources = sorted(of, key=lambda s: (s is not None, s or ""))
    given = [len(of[s]) ** 0.5 if weights is None else weights.get(s, min(weights.values())) for s in sources]
    times = naive_schedule([-(-len(of[s]) // block_rows) for s in sources], [Fraction(str(w)) for w in given])
    number = {(s, row[2]): k for s in sources for k, row in enumerate(sorted(of[s]))}
    out = pfair_mix.mix(small, weights, block_rows=block_rows).collect()
    assert len(out) == total
    for r in out:
        k = number[r.source, r.doc_id]
        slot, release, deadline = times[sources.index(r.source), k // block_rows]
        assert (r["__slot"], r["__release"], r["__deadline"], r["__position"]) == (slot, release, deadline, slot * block_rows + k % block_rows)


def test_one_document_of_each_group_is_exact(spark, small):
    kept = {r.doc_id for r in ngram_join.one_of_each_group(small).collect()}
    assert kept == {least for _, _, _, least in join_brute([(r.doc_id, r.text) for r in small.collect()], 5, 80)}
