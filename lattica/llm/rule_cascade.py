"""Operator 4: quality rules as a short-circuit cascade.

What rules look at is computed when a rule first asks for it, and at most once
for a text. Rules run one after another until one rejects; what later rules alone
would have asked for is never computed. Their order comes from a sample of the
whole table: each rule's seconds on texts of which nothing is computed yet, and
which of them it rejects. The rule with the most rejections per second goes
first, then the one with the most per second among the texts that are left, and
so on. A text is kept if no rule rejects it, so the order changes the cost and
never the verdict.

filter_documents orders the rules of the base (too few words, too many words in
repeated windows) together with the others. judge returns the base counts of
every text, so it computes them first, rejects by the base, and orders the other
rules by what the base leaves. Both use RULES; the query uses SQL_RULES, which
differ from them in texts with letters outside ASCII.

Defined results: null text is an empty text (no words, base failed, not kept);
rows are judged one by one, so repeated rows, null or repeated doc_ids and ties
have no effect; an empty table gives an empty result; other columns of the
input, whatever their names, are ignored (or carried along by filter_documents).
Whole texts are read. rejected_by names the first rule that rejects in the order
of that run; a text that several rules reject may have another one in the next.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, over_batches, prepare, texts_as_bytes

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_ASCII = bytes(range(0x80, 0x100))
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_NOT_LOWER = bytes(set(range(256)) - set(range(97, 123)))

#: Documented bound of the sample that fixes the rule order.
SAMPLE_ROWS = 400
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


class Facts:
    """What rules may look at, computed on demand; the counts are the base's."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _SPACES + _CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_window_words(self.words)


Rule = tuple[str, Callable[[Facts], bool]]


def _too_many_symbols(f: Facts) -> bool:
    return 10 * f.n_symbols > f.word_chars


def _too_many_repeated_lines(f: Facts) -> bool:
    return 10 * f.n_dup_lines > 6 * f.n_lines


def _odd_word_length(f: Facts) -> bool:
    return f.word_chars < 2 * f.n_words or f.word_chars > 20 * f.n_words


def _shouting_ascii(f: Facts) -> bool:
    return len(f.text.translate(None, _NOT_UPPER)) > len(f.text.translate(None, _NOT_LOWER))


def _shouting(f: Facts) -> bool:
    """More capitals than other letters, of any script."""
    if f.text.isascii():
        return _shouting_ascii(f)
    # if all that is not ASCII were capitals, would they outnumber the small letters of ASCII?
    others = len(f.text.translate(None, _CONTINUATION)) - len(f.text.translate(None, _NOT_ASCII))
    if len(f.text.translate(None, _NOT_UPPER)) + others <= len(f.text.translate(None, _NOT_LOWER)):
        return False
    text = f.text.decode("utf-8", "replace")
    return 2 * sum(map(str.isupper, text)) > sum(map(str.isalpha, text))


def _few_distinct_words(f: Facts) -> bool:
    return f.n_words >= 50 and 20 * len(set(f.words)) < f.n_words


RULES: tuple[Rule, ...] = (
    ("symbols", _too_many_symbols),
    ("repeated_lines", _too_many_repeated_lines),
    ("word_length", _odd_word_length),
    ("shouting", _shouting),
    ("few_distinct_words", _few_distinct_words),
)
#: The rules of ORACLE_SQL, whose shouting rule counts A-Z and a-z alone: what the query op4_rule_cascade has to return.
SQL_RULES: tuple[Rule, ...] = tuple((name, _shouting_ascii if name == "shouting" else rule) for name, rule in RULES)


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """How many words stand in a window of that width that occurs at least twice in the list."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, upto = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + width - max(at, upto)
            upto = at + width
    return covered


def _too_few_words(f: Facts) -> bool:
    return f.n_words < 10


def _too_many_repeated_words(f: Facts) -> bool:
    return 100 * f.n_repeat_words > 20 * f.n_words


BASE_RULES: tuple[Rule, ...] = (("too_few_words", _too_few_words), ("repeated_words", _too_many_repeated_words))


def base_failed(f: Facts) -> bool:
    return any(rejects(f) for _, rejects in BASE_RULES)


def measured(text: bytes, rules: tuple[Rule, ...]) -> list[tuple[float, bool]]:
    """Seconds and verdict of every rule on one text, each with nothing computed before."""
    out = []
    for _, rejects in rules:
        f = Facts(text)
        began = time.perf_counter()
        verdict = rejects(f)
        out.append((time.perf_counter() - began, verdict))
    return out


def ordered(names: list[str], rows: list[tuple[list[float], list[bool]]]) -> list[str]:
    """Names by rejections per second among what the ones before leave; rows: seconds and verdicts of each rule on a text."""
    cost = {n: sum(s[i] for s, _ in rows) / max(1, len(rows)) for i, n in enumerate(names)}
    left, out = list(range(len(rows))), []
    while len(out) < len(names):
        rest = [n for n in names if n not in out]
        hits = {n: sum(rows[r][1][names.index(n)] for r in left) for n in rest}
        best = min(rest, key=lambda n: (-hits[n] / max(cost[n], 1e-9), names.index(n)))
        left = [r for r in left if not rows[r][1][names.index(best)]]
        out.append(best)
    return out


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, after_base: bool = True) -> list[str]:
    """Rule names in the cascade's order, from a sample of about sample_rows rows over the whole table; after_base: of rows that the base leaves."""
    prepare(docs.sparkSession)
    names = [name for name, _ in rules]
    total = docs.count()
    if not total:
        return names

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measured(text, rules) for text in texts_as_bytes(batch.column(0)) if not after_base or not base_failed(Facts(text))]
        return pa.RecordBatch.from_arrays([pa.array([[c for c, _ in r] for r in rows], pa.list_(pa.float64())), pa.array([[v for _, v in r] for r in rows], pa.list_(pa.bool_()))], names=["seconds", "rejected"])

    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / total), seed=4)
    got = over_batches(sample, measure, "seconds array<double>, rejected array<boolean>").collect()  # about sample_rows rows
    return ordered(names, [(r["seconds"], r["rejected"]) for r in got])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep (default doc_id) with the base counts, base_failed, kept and the rule that rejected."""
    prepare(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    by_name = dict(rules)
    cascade = [(name, by_name[name]) for name in (order if order is not None else rule_order(docs, rules))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        for text in texts_as_bytes(batch.column(batch.num_columns - 1)):
            f = Facts(text)
            failed = base_failed(f)
            by = "base" if failed else next((name for name, rejects in cascade if rejects(f)), None)
            for c, v in zip(cols, (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, by is None, by), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
        arrays = [*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    # the text goes last under a name of our own: keep may hold it too, and any other name
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col("text").alias("t"))
    kept_schema = ", ".join(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    names = [*(f"k{i}" for i in range(len(keep))), *(x.split()[0] for x in BASE_SCHEMA.split(", "))]
    out = over_batches(source, run, f"{kept_schema}, {BASE_SCHEMA}" if keep else BASE_SCHEMA)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names[len(keep) :])


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that the cascade keeps, with the input's columns in their order."""
    prepare(docs.sparkSession)
    every = (*BASE_RULES, *rules)
    cascade = [dict(every)[name] for name in rule_order(docs, every, after_base=False)]
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        verdicts = [not any(rejects(f) for rejects in cascade) for f in map(Facts, texts_as_bytes(batch.column(at)))]
        return batch.filter(pa.array(verdicts, pa.bool_()))

    plain, _ = numbered(docs)
    return over_batches(plain, run, plain.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return judge(documents(spark, sf_dir), SQL_RULES).drop("rejected_by")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_chars,
         length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower_chars,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
win AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(list_distinct(ws)) AS n_distinct, upper_chars, lower_chars
  FROM w LEFT JOIN cov USING (r)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 6 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR upper_chars > lower_chars
            OR (n_words >= 50 AND 20 * n_distinct < n_words)) AS kept
FROM b
"""
