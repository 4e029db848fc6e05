"""Operator 3: language ID by hierarchical discrimination.

A text becomes a vector of hashed letter n-grams (orders 1 to 3; whatever is
not a letter ends a word). One linear machine for each language family, one
against the rest, picks the family; within it a linear support vector machine
for each pair of languages votes. Machines are trained on the driver on a
bounded sample of labelled rows (more languages than 400 are an error, none is
left out); all rows of the table are then scored where
they lie, without a shuffle, over their whole texts.

Families come from a fixed table of language codes; a language that it lacks
is a family of its own.

Defined results: null text or one without a letter is `und` with score 0;
nothing to learn from makes every prediction `und`; one language alone is
always predicted; equal votes go to the language that sorts first. Rows are
scored one by one, so repeated rows and null ids have no effect; an empty table
gives an empty result; other columns, whatever their names, are ignored. A row
without doc_id counts as held out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import packs, points, tables
from .common import held_out, over_batches, prepare

#: Families of language codes (ISO 639-1).
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
}

DIMENSIONS = 2048
#: Documented bound of the training sample, in rows.
TRAIN_ROWS = 3200
#: Rows that the sample has for each language on average at least: training fails with more than TRAIN_ROWS // LEAST_ROWS languages.
LEAST_ROWS = 8
_ORDERS = 3


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), f"={lang}")


def vectors(texts: list[str | None], dims: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts, and which of them have a letter."""
    lower, _ = tables()
    counts = np.zeros((len(texts), dims))
    lettered = np.zeros(len(texts), bool)
    for pack in packs([x or "" for x in texts], overlap=_ORDERS - 1):
        c = lower[points("".join(p + "\0" * (_ORDERS - 1 - (len(p) - n)) for _, p, n in pack))].astype(np.uint64)
        first, rows = pack[0][0], pack[-1][0] - pack[0][0] + 1
        # the code points after each piece's own are in no n-gram's first place
        owner = np.repeat(np.array([x for row, _, _ in pack for x in (row - first, rows)]), np.array([x for _, _, n in pack for x in (n, _ORDERS - 1)]))
        h, here, m = c, owner, len(c) - _ORDERS + 1
        total = np.zeros((rows + 1) * dims)
        for order in range(1, _ORDERS + 1):
            if order > 1:
                h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[order - 1 : m + order - 1]
            g, here = h[:m], owner[:m]
            real = (g != 0) if order == 1 else (c[:m] + c[order - 1 : m + order - 1] != 0)
            slot = ((g * np.uint64(0xD6E8FEB86659FD93 + 2 * order)) >> np.uint64(53)).astype(np.int64) % dims
            total += np.bincount((here * dims + slot)[real], minlength=len(total))
            if order == 1:
                lettered[first : first + rows] |= np.bincount(here[real], minlength=rows + 1)[:rows] > 0
        counts[first : first + rows] += total.reshape(rows + 1, dims)[:rows]
    x = np.sqrt(counts)
    return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32), lettered


def linear_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss; the last is the bias. y: 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (penalty + 2 * 2)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - np.float32(rate) * (np.float32(penalty) * v - 2 * (weight * y * slack) @ x)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    mean: np.ndarray | None = None
    #: of families, one against the rest
    family_w: np.ndarray | None = None
    #: of pairs of languages: positive means the first
    pair_w: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        x, lettered = vectors(texts)
        if not self.families:
            return ["und"] * len(texts), [0.0] * len(texts)
        x = x - self.mean
        sure = lambda w: 1 / (1 + np.exp(-np.clip(4 * (x @ w[:-1] + w[-1]), -50, 50)))
        p = np.stack([sure(w) for w in self.family_w], axis=1) if self.family_w is not None else np.ones((len(texts), 1))
        best = p.argmax(axis=1)
        pairs = {k: sure(w) for k, w in self.pair_w.items()}
        langs, scores = [], []
        shares = []
        for f in self.families:
            names = self.members[f]
            votes = np.zeros((len(texts), len(names)))
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                votes[:, i] += pairs[a, b]
                votes[:, j] += 1 - pairs[a, b]
            shares.append((votes / max(1, len(names) - 1)) if len(names) > 1 else np.ones((len(texts), 1)))
        for r in range(len(texts)):
            k = best[r]
            if not lettered[r]:
                langs.append("und")
                scores.append(0.0)
                continue
            vote = shares[k][r]
            i = int(vote.argmax())
            langs.append(self.members[self.families[k]][i])
            scores.append(float(min(1.0, max(0.0, p[r, k] * vote[i]))))
        return langs, scores


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    model = Model()
    if not names:
        return model
    for n in names:
        model.members.setdefault(family(n), []).append(n)
    model.families = sorted(model.members)
    model.mean = x.mean(axis=0)
    x = (x - model.mean).astype(np.float32)
    lang = np.array(langs)
    of = np.array([family(n) for n in langs])
    if len(model.families) > 1:
        model.family_w = np.stack([linear_machine(x, np.where(of == f, 1.0, -1.0)) for f in model.families])
    for members in model.members.values():
        for a, b in combinations(members, 2):
            here = (lang == a) | (lang == b)
            model.pair_w[a, b] = linear_machine(x[here], np.where(lang[here] == a, 1.0, -1.0))
    return model


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the not held-out rows: a sample by hash with equal shares of the languages, train_rows at most."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"), F.col("lang").alias("l")).filter(~held_out(F.col("i")) & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(train_rows // LEAST_ROWS + 1).collect()}
    if not counts:
        return Model()
    if len(counts) > train_rows // LEAST_ROWS:
        raise ValueError(f"more than {train_rows // LEAST_ROWS} languages for {train_rows} training rows")
    share = train_rows / len(counts)
    chance = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, share / n)))))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("train"), "i"), F.lit(1_000_003)) < F.element_at(chance, F.col("l")) * 1_000_003)
    # a few more than the bound may be drawn: those stay that come first by another hash
    drawn = drawn.orderBy(F.xxhash64(F.lit("bound"), "i", "t"), "i").limit(train_rows)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, lettered = vectors(batch.column(0).to_pylist())
        blobs = [v.astype(np.float16).tobytes() if ok else None for v, ok in zip(x, lettered, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1)], names=["x", "l"])

    got = over_batches(drawn.select("t", "l"), encode, "x binary, l string").filter("x is not null").toArrow()
    got = got.sort_by([("l", "ascending"), ("x", "ascending")])
    blobs = got.column("x").to_pylist()
    x = np.frombuffer(b"".join(blobs), np.float16).reshape(len(blobs), -1).astype(np.float32) if blobs else np.zeros((0, DIMENSIONS), np.float32)
    return fit(x, got.column("l").to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = model.predict(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
