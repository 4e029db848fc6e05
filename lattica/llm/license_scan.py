"""Operator 8: license scans with a positional rare-token index.

Words are those of the contract, A-Z in lower case. The index has every word of
the license templates with the templates and positions where it stands. A file's
license words are ranked by inverse document frequency, counted over all
documents, and of each template the file's RARE_WORDS highest ones are looked up.
A place of a looked-up word gives (template, position in the file minus position
in the template); a pair that enough of the postings of that template's looked-up
words agree on is an alignment, and it counts if the template's mandatory key
phrases stand at their places in it.

Base places (two or three words in a row) come from the same positions. All of
it is DataFrame functions on each row; only the frequencies are aggregated, one
row for each word of the templates. Texts are cut into words once: words of texts
that hold a word of some phrase are written for the second pass.

Defined results: null text is an empty text; without places first_word and
last_word are null; without labels both label columns are empty strings and the
score is 0; with a base label it is 1, else the largest share of the looked-up
postings that a counting alignment has. Rows are independent, so repeated rows,
null ids and ties have no effect; an empty table gives an empty result; other
columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Words after A-Z have become a-z, and what stands between them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, wording, mandatory key phrases (parts of the wording). Public license notices.
TEMPLATES = (
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    ("all-rights-reserved", "copyright all rights reserved", ("all rights reserved",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("except in compliance with the license", "www apache org licenses license 2 0")),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package", ("some semblance of artistic control",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("a creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("has waived all copyright and related or neighboring rights",)),
    ("eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify",)),
    ("lgpl", "licensed under the gnu lesser general public license version", ("lesser general public license",)),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mit-released", "released under the mit license", ("under the mit license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", ("unauthorized copying of this file",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "held liable for any damages arising")),
)

#: Creative Commons licenses by their short names, in all versions.
TEMPLATES += tuple((f"cc-{kind.replace(' ', '-')}", f"licensed under cc {kind} {version}", (f"cc {kind} {version}",)) for kind in ("by", "by nc", "by sa") for version in ("1 0", "2 0", "2 5", "3 0", "4 0"))

#: Words of a template that are looked up for a file, and the share of their postings that an alignment needs.
RARE_WORDS, NEEDED = 5, 0.6
#: Every base phrase and every first key phrase holds one of these pieces; a word with one is what texts are asked for.
_HINT = r"(?i)licen|redistribution|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by|creative|permission|unauthorized|reserved|semblance|endorse|organization|waived|unencumbered|warranty"
_FAR = 1 << 40


def words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _words(c: Column) -> Column:
    """Words of a text, for comparison with words of ASCII only.

    lower() is cheaper than translate() and differs from it in characters beyond ASCII, which stay
    such: the one that does not, the Kelvin sign, is replaced by another letter beyond ASCII.
    """
    return F.array_remove(F.split(F.lower(F.replace(c, F.lit("\u212a"), F.lit("\u00e9"))), _BETWEEN), "")


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()} | _hints(templates))


def _hints(templates) -> set[str]:
    """A word of every base phrase and every first key phrase: texts without any of these have no label."""
    phrases = [p for p, _ in BASE] + [keys[0] if keys else wording for _, wording, keys in templates]
    return {next((w for w in p.split() if re.search(_HINT, w)), p.split()[0]) for p in phrases}


def _read(docs: DataFrame, templates) -> DataFrame:
    """doc_id, n_words, found (words of the templates) and ws (all words of texts with a hint) of every row: texts are cut into words once."""
    rows = docs.select("doc_id", _words(F.coalesce("text", F.lit(""))).alias("ws"))
    rows = rows.withColumn("found", F.array_intersect("ws", F.array(*(F.lit(w) for w in _vocabulary(templates)))))
    hinted = F.arrays_overlap("found", F.array(*(F.lit(w) for w in sorted(_hints(templates)))))
    return rows.select("doc_id", F.size("ws").cast("long").alias("n_words"), "found", F.when(hinted, F.col("ws")).otherwise(F.array().cast("array<string>")).alias("ws"))


def _frequencies(rows: DataFrame) -> tuple[int, dict[str, int]]:
    # an empty word counts the documents
    got = rows.select(F.explode(F.concat(F.array(F.lit("")), "found")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in got}
    return counts.pop("", 0), counts


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that have each word of the templates."""
    return _frequencies(_read(docs, templates))


#: Of each template its words by descending inverse document frequency, with their positions.
Index = list[list[tuple[str, list[int]]]]


def rare_index(total: int, counts: dict[str, int], templates=TEMPLATES) -> Index:
    out = []
    for _, text, _ in templates:
        of = text.split()
        idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in of}
        out.append([(w, [i for i, x in enumerate(of) if x == w]) for w in sorted(set(of), key=lambda w: (-idf[w], w))])
    return out


def _phrases(templates) -> list[list[tuple[int, list[str]]]]:
    """Of each template its key phrases with their places in it."""
    out = []
    for _, wording, phrases in templates:
        of = wording.split()
        out.append([(next(i for i in range(len(of)) if of[i : i + len(p.split())] == p.split()), p.split()) for p in phrases])
    return out


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    read = table(_read(docs, templates), "license_words")
    index = rare_index(*_frequencies(read), templates)
    hinted = read.select("doc_id", "n_words", "ws")

    at = lambda ws, i: F.get(ws, i)

    def stands(ws: Column, i: Column, phrase: list[str]) -> Column:
        hit = at(ws, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            hit = hit & (at(ws, i + k) == word)
        return F.coalesce(hit, F.lit(False))

    ws = F.col("ws")
    vocabulary = sorted({w for entries in index for w, _ in entries})
    strings = lambda x: F.array(*(F.lit(w) for w in x))
    rows = hinted.withColumn("present", F.array_intersect("ws", strings(vocabulary)))
    # of each template the file's words by descending frequency rank, as an array for each template
    ranked = F.array(*(strings(w for w, _ in entries) for entries in index))
    rows = rows.withColumn("chosen", F.transform(ranked, lambda t: F.slice(F.array_intersect(t, F.col("present")), 1, RARE_WORDS)))
    posting = F.array(*(F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(w).alias("w"), F.array(*(F.lit(q).cast("bigint") for q in qs)).alias("qs")) for t, entries in enumerate(index) for w, qs in entries))
    rows = rows.withColumn("looked", F.when(F.size("present") > 0, F.filter(posting, lambda e: F.array_contains(F.get("chosen", e["t"].cast("int")), e["w"]))).otherwise(F.filter(posting, lambda e: F.lit(False))))
    wanted = F.array_distinct(F.concat(F.flatten("chosen"), strings(sorted({p.split()[0] for p, _ in BASE}))))
    rows = rows.withColumn("wanted", wanted)
    rows = rows.withColumn("spots", F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(F.col("wanted"), x["w"])))

    def base(k: int) -> Column:
        phrase = BASE[k][0].split()
        return F.transform(F.filter("spots", lambda x: stands(ws, x["i"], phrase)), lambda x: x["i"])

    rows = rows.select("*", *(base(k).alias(f"b{k}") for k in range(len(BASE))))
    # positions before the file's start stay apart from the template's neighbours: _FAR is larger than any text
    of_spot = lambda x: F.flatten(F.transform(F.filter("looked", lambda e: e["w"] == x["w"]), lambda e: F.transform(e["qs"], lambda q: e["t"] * _FAR + x["i"] - q)))
    rows = rows.withColumn("codes", F.array_sort(F.flatten(F.transform("spots", of_spot))))
    # how many postings were looked up for each template, and how many of them an alignment needs
    sizes = F.transform(F.sequence(F.lit(0), F.lit(len(index) - 1)), lambda t: F.aggregate(F.filter("looked", lambda e: e["t"] == t), F.lit(0), lambda n, e: n + F.size(e["qs"])))
    rows = rows.withColumn("sizes", F.when(F.size("codes") > 0, sizes))
    template = lambda c: F.floor((c + (_FAR >> 1)) / _FAR).cast("int")
    need = lambda c: F.ceil(F.get("sizes", template(c)) * NEEDED)
    start = F.struct(F.lit(None).cast("bigint").alias("c"), F.lit(0).alias("n"), F.array().cast("array<struct<c:bigint,n:int>>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        # the run of equal codes that ends before c is kept if it is long enough
        done = F.when(s["c"].isNotNull() & (s["n"] >= need(s["c"])), F.concat(s["found"], F.array(F.struct(s["c"].alias("c"), s["n"].alias("n"))))).otherwise(s["found"])
        same = F.coalesce(s["c"] == c, F.lit(False))
        return F.struct(c.alias("c"), F.when(same, s["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(same, s["found"]).otherwise(done).alias("found"))

    # one more code that equals none ends the last run
    ended = F.when(F.size("codes") > 0, F.concat("codes", F.array(F.lit(-(1 << 60))))).otherwise(F.col("codes"))
    rows = rows.withColumn("aligned", F.aggregate(ended, start, step, lambda s: s["found"]))
    places_of = _phrases(templates)

    def verified(x: Column) -> Column:
        t = template(x["c"])
        offset = (x["c"] - t.cast("bigint") * _FAR).cast("int")
        checks = F.lit(False)
        for k, phrases in enumerate(places_of):
            ok = t == k
            for q, p in phrases:
                ok = ok & (offset + q >= 0) & stands(ws, offset + q, p)
            checks = checks | ok
        return checks

    rows = rows.withColumn("ok", F.filter("aligned", verified))
    names = strings(label for label, _, _ in templates)
    places = F.concat(*(f"b{k}" for k in range(len(BASE))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))))
    rows = rows.withColumn("places", places).withColumn("bl", F.array_sort(base_labels)).withColumn("ml", F.transform("ok", lambda x: F.get(names, template(x["c"]))))
    best = F.array_max(F.transform("ok", lambda x: x["n"] / F.get("sizes", template(x["c"]))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("bl", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("bl", "ml")), ",").alias("labels"),
        F.when(F.size("bl") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0)))).alias("score"),
    )


def scan_text(text: str | None, index: Index, templates=TEMPLATES) -> tuple:
    """The same for one text, plainly: what tests compare with."""
    ws = words(text or "")
    stands = lambda i, p: i >= 0 and ws[i : i + len(p)] == p
    places, base_labels, labels, best, present = [], set(), set(), 0.0, set(ws)
    for phrase, label in BASE:
        here = [i for i in range(len(ws)) if stands(i, phrase.split())]
        places += here
        base_labels |= {label} if here else set()
    for (label, wording, _), entries, phrases in zip(templates, index, _phrases(templates), strict=True):
        looked = [(w, q) for w, qs in [e for e in entries if e[0] in present][:RARE_WORDS] for q in qs]
        for offset in range(-len(wording.split()), len(ws)):
            n = sum(0 <= offset + q < len(ws) and ws[offset + q] == w for w, q in looked)
            if looked and n >= math.ceil(NEEDED * len(looked)) and all(stands(offset + q, p) for q, p in phrases):
                labels.add(label)
                best = max(best, n / len(looked))
    score = 1.0 if base_labels else best
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), score


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return scan(documents(spark, sf_dir))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _sql() -> str:
    wording = [(t, q, w) for t, (_, text, _) in enumerate(TEMPLATES) for q, w in enumerate(text.split())]
    keys = [(t, q + i, w) for t, phrases in enumerate(_phrases(TEMPLATES)) for q, p in phrases for i, w in enumerate(p)]
    base = [(k, label, i, w) for k, (phrase, label) in enumerate(BASE) for i, w in enumerate(phrase.split())]
    return f"""
WITH tw(t, q, w) AS (VALUES {_values(wording)}),
kw(t, q, w) AS (VALUES {_values(keys)}),
bw(k, label, j, w) AS (VALUES {_values(base)}),
names(t, label) AS (VALUES {_values([(t, label) for t, (label, _, _) in enumerate(TEMPLATES)])}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
spot AS (
  SELECT r, i - 1 AS i, ws[i] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
  WHERE ws[i] IN (SELECT w FROM tw UNION SELECT w FROM bw)),
df AS (SELECT w, count(DISTINCT r) AS n FROM spot GROUP BY w),
place AS (
  SELECT r, k, label, i - j AS i FROM spot JOIN bw USING (w)
  GROUP BY r, k, label, i - j HAVING count(*) = (SELECT count(*) FROM bw b WHERE b.k = bw.k)),
chosen AS (
  SELECT r, t, w FROM (
    SELECT r, t, w, row_number() OVER (PARTITION BY r, t ORDER BY n, w) AS rank
    FROM (SELECT DISTINCT r, w FROM spot) JOIN (SELECT DISTINCT t, w FROM tw) USING (w) JOIN df USING (w))
  WHERE rank <= {RARE_WORDS}),
looked AS (SELECT r, t, w, q FROM chosen JOIN tw USING (t, w)),
size AS (SELECT r, t, count(*) AS total FROM looked GROUP BY r, t),
aligned AS (SELECT r, t, i - q AS o, count(*) AS n FROM looked JOIN spot USING (r, w) GROUP BY r, t, i - q),
good AS (
  SELECT a.r, a.t, a.n / s.total AS share FROM aligned a JOIN size s ON a.r = s.r AND a.t = s.t
  WHERE a.n >= ceil({NEEDED} * s.total)
    AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.t = a.t AND NOT EXISTS (SELECT 1 FROM spot p WHERE p.r = a.r AND p.i = a.o + kw.q AND p.w = kw.w))),
of_base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM place GROUP BY r),
every AS (SELECT r, label FROM place UNION SELECT r, label FROM good JOIN names USING (t)),
of_all AS (SELECT r, array_to_string(list_sort(list(label)), ',') AS labels FROM every GROUP BY r),
best AS (SELECT r, max(share) AS share FROM good GROUP BY r)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN base_labels IS NOT NULL THEN 1.0 ELSE least(1.0, coalesce(share, 0.0)) END::DOUBLE AS score
FROM d LEFT JOIN of_base USING (r) LEFT JOIN of_all USING (r) LEFT JOIN best USING (r)
"""


ORACLE_SQL = _sql()
