"""Operators 1, 3, 4, 7 and 8: rows judged one by one."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe_automaton, codepoints, language_id, license_scan, quality_mil, rule_cascade
from tests.llm.conftest import SF


def ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())


def test_rules_match_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = sorted(c.sql(rule_cascade.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in rule_cascade.query(spark, SF).collect()) == want


def test_rules_awkward(awkward, empty):
    out = rule_cascade.judge(awkward)
    assert ids(out) == ids(awkward)
    null = out.where("doc_id = 1").first()
    assert (null.n_words, null.base_failed, null.kept, null.rejected_by) == (0, True, False, "base")
    assert rule_cascade.judge(empty).count() == 0 and rule_cascade.filter_documents(empty).columns == awkward.columns
    kept = rule_cascade.filter_documents(awkward)
    assert kept.columns == awkward.columns and ids(kept) == ids(out.where("kept"))


def test_rules_order_changes_nothing(small):
    names = [n for n, _ in rule_cascade.RULES]
    a = rule_cascade.judge(small, order=names).drop("rejected_by").collect()
    assert sorted(a) == sorted(rule_cascade.judge(small, order=names[::-1]).drop("rejected_by").collect())
    assert sorted(rule_cascade.rule_order(small)) == sorted(names)


def test_rules_keep_other_scripts(spark):
    """One Latin acronym in a text without Latin letters is no shouting; capitals of any script are."""
    russian = "Учёные сообщили что новая вакцина против COVID прошла первые испытания и вскоре поступит в больницы"
    arabic = "أعلن العلماء أن اللقاح الجديد ضد COVID اجتاز التجارب الأولى وسيصل قريبا إلى المستشفيات"
    english = "scientists said that the new vaccine against COVID has passed its first trials and will soon come"
    rows = list(enumerate([russian, arabic, english, russian.upper(), english.upper(), "été " * 3 + english.upper()]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(rule_cascade.filter_documents(docs)) == [(False, 0), (False, 1), (False, 2)]
    assert [r.rejected_by for r in rule_cascade.judge(docs).orderBy("doc_id").collect()] == [None] * 3 + ["shouting"] * 3


@pytest.mark.parametrize(("words", "width", "want"), [("a b", 5, 0), ("a a a a a a", 5, 6), ("a b c d e x a b c d e", 5, 10), ("a b c d e f", 5, 0), ("a b a b a", 2, 5)])
def test_repeated_windows(words, width, want):
    assert rule_cascade.repeated_window_words([w.encode() for w in words.split()], width) == want


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe_automaton.default_path())
    theirs.no_truncation()
    theirs.no_padding()
    ours = bpe_automaton.load(bpe_automaton.default_path())
    rnd = random.Random(7)
    pools = ["thein gand", "'s 't 're 've 'm 'll 'd DON'T ", "éèñßÉΣςİıǅ", "日本語한국어", "0189½Ⅷ٣", "\x1c\x1d\x85\xa0​　﻿ \t\n", "😀👍🏽̧", "!?.#$&"]
    texts = ["", " ", "a" * 300, "<|endoftext|>", "x<|startoftext|> y<|endoftext|>"] + ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want, repr(t)
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_automaton_small():
    """Every string over two letters against merging by rank."""
    symbols = ["a", "b", "a$", "b$"]
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a$"), ("ab", "ba$"), ("aa", "a$")]
    vocab = {t: i for i, t in enumerate(symbols + [x + y for x, y in merges])}
    auto = bpe_automaton.Automaton(vocab, merges, "$")
    names = {i: t for t, i in vocab.items()}
    for n in range(1, 11):
        for bits in range(1 << n):
            word = [("ab"[bits >> i & 1]) for i in range(n)]
            tokens = word[:-1] + [word[-1] + "$"]
            for x, y in merges:
                i = 0
                while i < len(tokens) - 1:
                    if (tokens[i], tokens[i + 1]) == (x, y):
                        tokens[i : i + 2] = [x + y]
                    i += 1
            assert [names[i] for i in auto.encode("".join(word))] == tokens


def test_bpe_awkward(awkward, empty):
    out = bpe_automaton.encode_documents(awkward, with_ids=True)
    assert ids(out) == ids(awkward) and bpe_automaton.encode_documents(empty).count() == 0
    none = out.where("doc_id = 1").first()
    assert none.n_tokens == 0 and none.ids_sha256 == none.decoded_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert all(r.n_tokens == len(r.token_ids) for r in out.collect())


def test_languages(small, awkward, empty):
    model = language_id.train(small)
    truth = {r.doc_id: r.lang for r in small.collect()}
    out = language_id.identify(small, model).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    strange = language_id.identify(awkward, model)
    assert ids(strange) == ids(awkward) and {r.lang_pred for r in strange.where("doc_id in (1, 2, 3)").collect()} == {"und"}
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(small.limit(3), nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    one = language_id.train(small.where("lang = 'fr'"))
    assert {r.lang_pred for r in language_id.identify(small.limit(3), one).collect()} == {"fr"}


def test_more_languages_than_rows_have_room_for(small):
    many = small.withColumn("lang", F.concat(F.lit("x"), F.pmod("doc_id", F.lit(5)).cast("string")))
    with pytest.raises(ValueError, match="more than 4 languages"):
        language_id.train(many, train_rows=32)
    assert len(language_id.train(many, train_rows=40).families) == 5


def test_quality(spark, small, awkward, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_mil.train(small, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = quality_mil.score(small, model).collect()
    both = [(r.predicted, truth[r.doc_id]) for r in out if r.doc_id in truth]
    assert np.mean([a == b for a, b in both]) >= 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert ids(quality_mil.score(awkward, model)) == ids(awkward)
    assert quality_mil.score(empty, model).count() == 0
    assert {r.score for r in quality_mil.score(small.limit(2), quality_mil.train(small, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality_mil.score(small.limit(2), quality_mil.train(small, labels.where("quality = 1"))).collect()} == {1.0}


def test_quality_gradient():
    """Training lowers the loss on bags that only one passage tells apart."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    bag = np.repeat(np.arange(100), 4)
    y = (np.arange(100) % 2).astype(np.float32)
    x[4 * np.arange(100), 0] += 6 * (2 * y - 1)
    model = quality_mil.fit(x, bag, y, np.ones(100, np.float32))
    s = model.forward((x - model.mean) / model.scale, np.arange(0, 400, 4), bag)["s"]
    assert ((s > 0.5) == (y > 0)).mean() >= 0.95


def test_cut_texts_are_whole(monkeypatch):
    text = "hello wörld again " * 90
    a, _ = language_id.vectors([text, "x"])
    monkeypatch.setattr(codepoints.packs, "__defaults__", (64, 0))
    b, _ = language_id.vectors([text, "x"])
    assert np.abs(a - b).max() < 1e-6


def test_licenses_match_plain_scan(spark, small, awkward, empty):
    extra = ["MIT License", "mit   LICENSE. mit license general PUBLIC license", "License Apache", "Public License version 3. gnu general public license, version 3", "MİT license", "Permission is hereby granted, free of charge, to any person", "redistribution and use in source and binary forms " * 30, "cc by 4 0 cc by nc 4 0"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    docs = small.select("doc_id", "text").union(awkward.select("doc_id", "text").where("doc_id is not null and doc_id <> 9").withColumn("doc_id", awkward.doc_id + 2000)).union(more)
    index = license_scan.rare_index(*license_scan.document_frequencies(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        assert tuple(r)[1:] == license_scan.scan_text(texts[r.doc_id], index), r.doc_id
    assert license_scan.scan(empty).count() == 0 and ids(license_scan.scan(awkward)) == ids(awkward)


def plain_features(text):
    """Passage features with plain loops."""
    _, kinds = codepoints.tables()
    out = []
    for at in range(0, max(1, len(text)), quality_mil.PASSAGE):
        p = text[at : at + quality_mil.PASSAGE]
        k = [int(kinds[ord(c)]) for c in p]
        n = len(codepoints.CLASSES)
        share = [0.0] * (n * n)
        for x, y in zip(k, k[1:], strict=False):
            share[x * n + y] += 1
        share = [(v / max(1, len(p) - 1)) ** 0.5 for v in share]
        slots = set()
        for i in range(len(p) - 5):
            h = 0
            for c in p[i : i + 6]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            slots.add((h * 0xD6E8FEB86659FD93) % 2**64 >> 54)
        expected = quality_mil._BUCKETS * (1 - np.exp(-max(0, len(p) - 5) / quality_mil._BUCKETS))
        spaces = sum(x in (3, 4) for x in k)
        out.append([*share, len(slots) / max(1, expected), np.log1p(len(p)) / 6, min(3, len(p) / (spaces + 1) / 10), float(not p)])
    return out


def plain_score(model, text):
    """Gated attention over the passages, one number at a time."""
    p, hidden, weights = model.p, [], []
    for x in plain_features(text):
        x = [(a - m) / s for a, m, s in zip(x, model.mean, model.scale, strict=True)]
        h = [np.tanh(sum(a * w for a, w in zip(x, col, strict=True)) + b) for col, b in zip(p["w"].T, p["wb"], strict=True)]
        a = [np.tanh(sum(u * w for u, w in zip(h, col, strict=True))) for col in p["v"].T]
        g = [1 / (1 + np.exp(-sum(u * w for u, w in zip(h, col, strict=True)))) for col in p["u"].T]
        hidden.append(h)
        weights.append(np.exp(sum(x * y * q for x, y, q in zip(a, g, p["q"], strict=True))))
    z = [sum(w * h[i] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for i in range(len(p["c"]))]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["cb"][0])))


def test_quality_plainly_and_held_out(spark):
    """Scores equal a plain-loop forward pass; on held-out rows they rank and decide as the labels do."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.train(docs, labels)
    texts = ["", "a", "Hello, world! 12", "ÀÉ x" * 300, "word " * 400] + [r.text for r in docs.orderBy("doc_id").limit(20).collect()]
    for t, s in zip(texts, model.score(texts), strict=True):
        assert abs(plain_score(model, t) - s) < 1e-3
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in quality_mil.score(docs, model).where("held_out").collect() if r.doc_id in truth]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert len(held) > 50 and np.mean([p == y for _, p, y in held]) >= 0.93
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) >= 0.97


def plain_vector(text):
    """Counts of hashed n-grams of letters, with plain loops."""
    lower, _ = codepoints.tables()
    c = [int(lower[ord(x)]) for x in text]
    counts = [0.0] * language_id.DIMENSIONS
    for order in (1, 2, 3):
        for i in range(len(c)):
            gram = [c[i + j] if i + j < len(c) else 0 for j in range(order)]
            if (gram[0] == 0) if order == 1 else (gram[0] + gram[-1] == 0):
                continue
            h = gram[0]
            for x in gram[1:]:
                h = (h * 0x9E3779B97F4A7C15 + x) % 2**64
            if h == 0 and order == 1:
                continue
            counts[((h * (0xD6E8FEB86659FD93 + 2 * order)) % 2**64 >> 53) % language_id.DIMENSIONS] += 1
    v = [x**0.5 for x in counts]
    norm = max(1e-9, sum(x * x for x in v) ** 0.5)
    return [x / norm for x in v]


def test_languages_plainly(small):
    """Predictions and scores from plain loops: family first, then the votes of pairs within it."""
    model = language_id.train(small)
    sure = lambda x, w: 1 / (1 + np.exp(-max(-50, min(50, 4 * (sum(a * b for a, b in zip(x, w[:-1], strict=True)) + w[-1])))))
    texts = ["Hello world", "é", "123", "der die das ß"] + [r.text for r in small.orderBy("doc_id").limit(25).collect() if r.text]
    got_langs, got_scores = model.predict(texts)
    for text, lang, score in zip(texts, got_langs, got_scores, strict=True):
        if not any(ch.isalpha() for ch in text):
            assert (lang, score) == ("und", 0.0)
            continue
        x = [a - m for a, m in zip(plain_vector(text), model.mean, strict=True)]
        of_family = [sure(x, w) for w in model.family_w]
        f = max(range(len(of_family)), key=lambda i: of_family[i])
        names = model.members[model.families[f]]
        votes = {n: 0.0 for n in names}
        for (a, b), w in model.pair_w.items():
            if a in votes:
                votes[a] += sure(x, w)
                votes[b] += 1 - sure(x, w)
        share = {n: v / (len(names) - 1) if len(names) > 1 else 1.0 for n, v in votes.items()}
        best = max(names, key=lambda n: share[n])
        assert abs(of_family[f] * share[best] - score) < 1e-3
        assert lang == best or abs(share[lang] - share[best]) < 1e-4


def test_bpe_query_equals_library(spark):
    """The query's counts and hashes against the tokenizers library, on whole texts."""
    import hashlib

    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe_automaton.default_path())
    theirs.no_truncation()
    theirs.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = bpe_automaton.query(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))


def test_cascade_spares_what_it_does_not_need(monkeypatch):
    """After a rejection no further fact is computed; rules are ordered by what the ones before leave."""
    f = rule_cascade.Facts(b"#" * 40)
    assert rule_cascade._too_many_symbols(f) and set(vars(f)) == {"text", "n_symbols", "word_chars"}
    rows = [([1.0, 4.0, 1.0], [True, True, False])] * 6 + [([1.0, 4.0, 1.0], [False, True, True])] * 3
    # the second rejects all, at four times the cost; the first and the third together do so for less
    assert rule_cascade.ordered(["a", "b", "c"], rows) == ["a", "c", "b"]


def test_licenses_match_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(map(repr, c.sql(license_scan.ORACLE_SQL).fetchall())) == sorted(repr(tuple(r)) for r in license_scan.query(spark, SF).collect())


def test_license_templates():
    """Key phrases stand in their wordings, the first one of each template holds a hint, and each template finds itself."""
    import re

    counts = {w: 1 for _, text, _ in license_scan.TEMPLATES for w in text.split()}
    index = license_scan.rare_index(10, counts)
    for label, wording, phrases in license_scan.TEMPLATES:
        assert all(f" {p} " in f" {wording} " for p in phrases) and re.search(license_scan._HINT, phrases[0])
        assert label in license_scan.scan_text(f"Some words. {wording.upper()}; more words", index)[5].split(",")


def test_license_texts_are_read_once(spark, tmp_path):
    """The frequencies and the scan share one pass over the texts; letters beyond ASCII never become ASCII ones."""
    rows = [(1, "MIT License \u212a"), (2, "the \u212aind of wor\u212a"), (3, "M\u0130T LICEN\u017fE, mit LICENSE"), (4, None), (5, ".."), (6, "one two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = license_scan.scan(docs)
    assert not any("documents.parquet" in f for f in out.inputFiles())
    index = license_scan.rare_index(*license_scan.document_frequencies(docs))
    assert [tuple(r)[1:] for r in out.orderBy("doc_id").collect()] == [license_scan.scan_text(t, index) for _, t in rows]
    every = [(c, "a" + chr(c) + "a") for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    letters = spark.createDataFrame(every, "c int, text string").select("c", license_scan._words("text").alias("ws"))
    assert letters.where("size(ws) <> 1 or ws[0] rlike '^[a-z]+$'").count() == 0
