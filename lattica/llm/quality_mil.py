"""Operator 1: quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE code points. Every passage is encoded
(shares of character classes and of pairs of them, line and repetition figures,
then a learned tanh layer), a learned gated attention weighs the passages of a
document, and a logistic unit scores the weighted passage representation. All of
it is trained together on document labels only, by full-batch Adam on the driver
over a bounded sample of labelled rows; then every whole text is scored where it
lies, without a shuffle.

Defined results: null and empty texts are one passage without characters, scored
as such; without both labels to learn from the score is the share of label 1
(0.5 if there is none). Labels other than 0 and 1 and null labels are not used.
A document with several labels lends its passages to each. Rows are scored one by
one, so repeated rows and null ids have no effect; a row without doc_id counts as
held out. An empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import CLASSES, packs, points, tables
from .common import held_out, over_batches, prepare

PASSAGE = 512
#: Documented bounds of the training sample: its documents, and the length (in passages) up to which a labelled
#: document can be drawn for it. A drawn document is learned from whole, and documents of any length are scored whole.
TRAIN_ROWS, TRAIN_PASSAGES = 3000, 400
KEEP_AT = 0.3
_KINDS = len(CLASSES)
_BUCKETS = 1024
FEATURES = _KINDS * _KINDS + 4


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One row of features for each passage, and the text that it belongs to, in order."""
    _, kinds = tables()
    rows, owners = [], []
    for pack in packs([x or "" for x in texts]):
        c = points("".join(p for _, p, _ in pack))
        sizes = np.array([n for _, _, n in pack])
        parts = np.maximum(1, -(-sizes // PASSAGE))
        owners.append(np.repeat(np.array([r for r, _, _ in pack]), parts))
        count = int(parts.sum())
        first_part = np.cumsum(parts) - parts
        start = np.cumsum(sizes) - sizes
        at = np.repeat(first_part, sizes) + (np.arange(len(c)) - np.repeat(start, sizes)) // PASSAGE
        k = kinds[c].astype(np.int64)
        size = np.bincount(at, minlength=count)
        same = at[1:] == at[:-1]
        pair = (at[1:] * _KINDS * _KINDS + k[:-1] * _KINDS + k[1:])[same]
        share = np.bincount(pair, minlength=count * _KINDS * _KINDS).reshape(count, -1) / np.maximum(1, size - 1)[:, None]
        # how few different 6-grams there are for the length: repetition
        grams = max(0, len(c) - 5)
        h = np.zeros(grams, np.uint64)
        for i in range(6):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : grams + i]
        inside = at[:grams] == at[len(c) - grams :]
        slot = (at[:grams] * _BUCKETS + ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(54)).astype(np.int64))[inside]
        distinct = (np.bincount(slot, minlength=count * _BUCKETS).reshape(count, -1) > 0).sum(axis=1)
        expected = _BUCKETS * (1 - np.exp(-np.maximum(0, size - 5) / _BUCKETS))
        spaces = np.bincount(at, weights=(k == 3) | (k == 4), minlength=count)
        more = np.stack([distinct / np.maximum(1, expected), np.log1p(size) / 6, np.minimum(3, size / (spaces + 1) / 10), size == 0], axis=1)
        rows.append(np.hstack([np.sqrt(share), more]))
    if not rows:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    return np.vstack(rows).astype(np.float32), np.concatenate(owners)


@dataclass
class Model:
    """Parameters; without `p` a constant score."""

    constant: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    p: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """starts: first passage of each bag; bag: each passage's bag. No bag is empty."""
        p, o = self.p, {}
        o["h"] = np.tanh(x @ p["w"] + p["wb"])
        o["a"], o["g"] = np.tanh(o["h"] @ p["v"]), 1 / (1 + np.exp(-(o["h"] @ p["u"])))
        e = (o["a"] * o["g"]) @ p["q"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        o["t"] = e / np.add.reduceat(e, starts)[bag]
        o["z"] = np.add.reduceat(o["t"][:, None] * o["h"], starts)
        o["s"] = 1 / (1 + np.exp(-np.clip(o["z"] @ p["c"] + p["cb"], -40, 40)))
        return o

    def score(self, texts: list[str | None]) -> list[float]:
        if self.p is None or not texts:
            return [self.constant] * len(texts)
        x, bag = passage_features(texts)
        starts = np.searchsorted(bag, np.arange(len(texts)))
        return [float(v) for v in self.forward((x - self.mean) / self.scale, starts, bag)["s"]]


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int = 24, gate: int = 12, steps: int = 250) -> Model:
    """y, weight: by bag. bag ascends and skips none."""
    total = weight.sum()
    model = Model(float((weight * y).sum() / total) if total else 0.5)
    if len(set(y.tolist())) < 2:
        return model
    rng = np.random.default_rng(1)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - model.mean) / model.scale).astype(np.float32)
    d = x.shape[1]
    model.p = {
        "w": rng.normal(0, d**-0.5, (d, width)), "wb": np.zeros(width),
        "v": rng.normal(0, width**-0.5, (width, gate)), "u": rng.normal(0, width**-0.5, (width, gate)), "q": rng.normal(0, 0.3, gate),
        "c": rng.normal(0, width**-0.5, width), "cb": np.zeros(1),
    }
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    starts = np.searchsorted(bag, np.arange(len(y)))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    weight = (weight / total).astype(np.float32)
    for step in range(1, steps + 1):
        p, o = model.p, model.forward(x, starts, bag)
        ds = weight * (o["s"] - y)
        dz = (ds[:, None] * p["c"])[bag]
        dh = o["t"][:, None] * dz
        dt = (dz * o["h"]).sum(axis=1)
        de = o["t"] * (dt - np.add.reduceat(o["t"] * dt, starts)[bag])
        da = de[:, None] * p["q"] * o["g"] * (1 - o["a"] ** 2)
        dg = de[:, None] * p["q"] * o["a"] * o["g"] * (1 - o["g"])
        dh = (dh + da @ p["v"].T + dg @ p["u"].T) * (1 - o["h"] ** 2)
        grad = {"w": x.T @ dh, "wb": dh.sum(axis=0), "v": o["h"].T @ da, "u": o["h"].T @ dg, "q": (o["a"] * o["g"]).T @ de, "c": o["z"].T @ ds, "cb": ds.sum(keepdims=True)}
        for k in p:
            g = grad[k] + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p[k] = (p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from not held-out labelled rows: a sample by hash with up to half of train_rows for each label."""
    prepare(docs.sparkSession)
    marks = labels.select(F.col("doc_id").alias("i"), F.col("quality").cast("int").alias("y")).filter(~held_out(F.col("i")) & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(0.5)
    half = train_rows // 2
    chance = F.when(F.col("y") == 1, min(1.0, half / counts.get(1, 1))).otherwise(min(1.0, half / counts.get(0, 1)))
    # the rows drawn are ids and marks only, train_rows at most: small enough to send to every executor
    drawn = marks.filter(F.pmod(F.xxhash64(F.lit("train"), "i"), F.lit(1_000_003)) < chance * 1_000_003).orderBy(F.xxhash64("i"), "i", "y").limit(train_rows)
    fits = F.coalesce(F.length("t"), F.lit(0)) <= TRAIN_PASSAGES * PASSAGE
    bags = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).where(fits).join(F.broadcast(drawn), "i").select("t", "i", "y")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, bag = passage_features(batch.column(0).to_pylist())
        blobs = []
        for r in range(batch.num_rows):
            mine = x[np.searchsorted(bag, r) : np.searchsorted(bag, r, "right")]
            blobs.append(mine.astype(np.float16).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1), batch.column(2)], names=["x", "i", "y"])

    # a doc_id may stand in many rows of documents; the bound holds for them too, in the order of a hash
    kind = bags.schema["i"].dataType.simpleString()
    encoded = over_batches(bags, encode, f"x binary, i {kind}, y int")
    got = encoded.orderBy(F.xxhash64("i", "x"), "i", "y", "x").limit(train_rows).toArrow().sort_by([("i", "ascending"), ("y", "ascending"), ("x", "ascending")])
    if not got.num_rows:
        return Model(0.5)
    parts = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for b in got.column("x").to_pylist()]
    y = np.array(got.column("y").to_pylist(), np.float32)
    # each label weighs what it has among all labelled rows, so that scores are probabilities
    seen = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(int(k), 0) / seen[int(k)] for k in y], np.float32)
    return fit(np.vstack(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), y, weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(v >= KEEP_AT) for v in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    import os

    from .common import documents

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))))
