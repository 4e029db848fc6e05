"""Operator 5: mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. With weight w, block j of a source may
run from floor(j / w) on and must have run by ceil((j + 1) / w); one block runs
at a time, of those released the one with the earliest deadline. Then at every
time each source has had its share of all blocks so far, less or more than one
block. Weights are exact: the decimal fractions that they are written as, made
integers with the same proportions. Their sum is the period after which a
schedule repeats. The driver computes one period of a phase, or the phase where
that is shorter (square roots have long periods): a step for each block at most,
none for each row. Executors get the times as a table, joined by block.

A source that ends leaves its share to the others: a phase ends with the block
that exhausts a source, and the next one starts with the remaining sources and
their weights scaled up. So every row gets a place, none is repeated or dropped,
and the weights hold for as long as there are rows to hold them with.

Rows of a source are in hash order. Their number within the source comes from
counts of small buckets and a row number within the bucket, so a source of any
size is spread over many tasks. Everything on the rows is DataFrame functions.

Defined results: a null source is a source of its own; rows that repeat id and
text stand next to each other in any order, being equal; null ids and null texts
have hashes like others; a source without a weight gets the smallest weight that
is given; weights of absent sources are ignored; weights must be positive; an
empty table gives an empty result. Columns of any other names, dotted or like our own,
are carried along.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered

BLOCK_ROWS = 64
#: Rows of a bucket within which rows are numbered by sorting, about.
BUCKET_ROWS = 4096
#: Sources are listed on the driver: more of them is an error.
MOST_SOURCES = 1024
#: Text of a partition of mixed documents, and its rows at most.
PARTITION_BYTES, MOST_ROWS = 16 << 20, 65536


def exact_shares(weights: list[float]) -> list[int]:
    """Integers in exactly the proportions of the weights as they are written, without a common divisor."""
    exact = [Fraction(str(w)) for w in weights]
    over = math.lcm(*(w.denominator for w in exact))
    shares = [int(w * over) for w in exact]
    common = math.gcd(*shares)
    return [a // common for a in shares]


def one_period(shares: list[int], left: list[int]) -> tuple[list[list[int]], bool]:
    """For each source the times of its blocks by earliest deadline first, and whether a source ended.

    It stops with the block that exhausts a source, or else after a period, the sum of the shares.
    """
    period, times = sum(shares), [[] for _ in shares]
    ready: list[tuple[int, int]] = []
    waiting = [(0, i) for i in range(len(shares))]
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(times[i]) + 1) * period // shares[i]), i))
        deadline, i = heapq.heappop(ready)
        if deadline <= now:
            raise AssertionError("a deadline was missed")
        times[i].append(now)
        k = len(times[i])
        if k == left[i]:
            return times, True
        if k < shares[i]:
            heapq.heappush(waiting, (k * period // shares[i], i))
    return times, False


def schedule(blocks: list[int], weights: list[float], period: int | None = None) -> list[list[dict]]:
    """For each source its phases: number of its first block, start time, share and times within a period.

    The period follows from the weights; the argument is taken for older callers and has no effect.
    """
    left, out, start, number = dict(enumerate(blocks)), [[] for _ in blocks], 0, 0
    taken = [0] * len(blocks)
    left = {i: n for i, n in left.items() if n}
    while left:
        active = sorted(left)
        shares = exact_shares([weights[i] for i in active])
        size = sum(shares)
        times, ended = one_period(shares, [left[i] for i in active])
        # the first source whose last block has run ends the phase
        length = sum(map(len, times)) if ended else min((left[i] - 1) // a * size + t[(left[i] - 1) % a] for i, a, t in zip(active, shares, times, strict=True)) + 1
        for i, a, t in zip(active, shares, times, strict=True):
            out[i].append({"phase": number, "first": taken[i], "start": start, "period": size, "share": a, "times": t})
            done = length // size * a + bisect.bisect_left(t, length % size)
            taken[i] += done
            left[i] -= done
        left = {i: n for i, n in left.items() if n > 0}
        start, number = start + length, number + 1
    return out


_PHASES = "sid int, source string, none boolean, phases array<struct<phase:int, first:bigint, start:bigint, period:bigint, share:bigint>>"
#: Shares and periods beyond this are of phases that end within the first period.
_LONG = 1 << 62


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded table of the driver's, without Python on executors."""
    fields = ", ".join(x.replace(" ", ":", 1) for x in _split(schema))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def _times(spark: SparkSession, phases: list[list[dict]]) -> DataFrame:
    """The times of all phases, with releases and deadlines, as a table of the driver's."""
    cols: list[list[int]] = [[] for _ in range(6)]
    for i, ps in enumerate(phases):
        for p in ps:
            n, size, a = len(p["times"]), p["period"], p["share"]
            values = ([i] * n, [p["phase"]] * n, range(n), p["times"], (k * size // a for k in range(n)), (-(-(k + 1) * size // a) for k in range(n)))
            for c, v in zip(cols, values, strict=True):
                c.extend(v)
    names = ["sid4", "phase4", "k4", "at", "from", "until"]
    return spark.createDataFrame(pa.table({name: pa.array([min(v, _LONG) for v in c], pa.int64()) for name, c in zip(names, cols, strict=True)}))


def _split(schema: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


#: What mix adds to each row.
PLACES = ("phase", "block", "offset", "release", "deadline", "slot", "position")


def _placed(docs: DataFrame, weights: dict[str | None, float] | None, block_rows: int, total: int) -> DataFrame:
    """docs under numbered names, with PLACES."""
    spark = docs.sparkSession
    plain, names = numbered(docs)
    source, doc_id, text = (F.col(names[c]) for c in ("source", "doc_id", "text"))
    buckets = max(1, -(-total // BUCKET_ROWS))
    keyed = plain.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), doc_id, text), F.lit(buckets)))
    # bucket counts: one row for each source and bucket
    counts = keyed.groupBy(source.alias("s"), F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("s").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = sorted(sizes, key=lambda r: (r[0] is not None, r[0] or ""))
    sources = [r[0] for r in sizes]
    if weights is None:
        given = [r[1] ** 0.5 for r in sizes]
    else:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("weights must be positive")
        given = [weights.get(s, min(weights.values())) for s in sources]
    phases = schedule([-(-r[1] // block_rows) for r in sizes], given)
    # the plan as tables: the phases of each source, and the times, releases and deadlines of each phase's period
    short = [{"sid": i, "source": s or "", "none": s is None, "phases": [{k: min(v, _LONG) for k, v in p.items() if k != "times"} for p in ps]} for i, (s, ps) in enumerate(zip(sources, phases, strict=True))]
    of_source = _small(spark, short, _PHASES).select(F.when(~F.col("none"), F.col("source")).alias("s3"), "sid", "phases")
    at = _times(spark, phases)

    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("s", "b", "n", before.alias("before"))
    # small tables as yet, a row for each bucket's blocks: texts then meet their slots by bucket
    plan = starts.withColumn("block", F.explode(F.sequence(F.floor(F.col("before") / block_rows), F.floor((F.col("before") + F.col("n") - 1) / block_rows))))
    # this broadcast is bounded by MOST_SOURCES, whatever the rows
    plan = plan.join(F.broadcast(of_source), F.col("s").eqNullSafe(F.col("s3")))
    plan = plan.withColumn("p", F.expr("element_at(filter(phases, p -> p.first <= block), -1)")).withColumn("step", F.expr("block - p.first")).withColumn("k", F.expr("step % p.share")).drop("phases")
    plan = plan.join(at, F.expr("sid = sid4 and p.phase = phase4 and k = k4")).withColumn("base", F.expr("p.start + (step div p.share) * p.period"))
    entry = F.struct("block", F.col("p.phase").alias("phase"), *((F.col("base") + F.col(c)).alias(name) for c, name in (("from", "release"), ("until", "deadline"), ("at", "slot"))))
    plan = plan.groupBy("s", "b", "before").agg(F.array_sort(F.collect_list(entry)).alias("plan"))
    order = [F.xxhash64(F.lit("mix"), doc_id, text), doc_id, F.xxhash64(text)]
    within = F.row_number().over(Window.partitionBy(source, "bucket").orderBy(*order)) - 1
    rows = keyed.withColumn("within", within).join(plan, source.eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    number = F.col("before") + F.col("within")
    rows = rows.withColumn("block", F.floor(number / block_rows)).withColumn("offset", number % block_rows)
    rows = rows.withColumn("e", F.get("plan", (F.col("block") - F.floor(F.col("before") / block_rows)).cast("int")))
    position = (F.col("e.slot") * block_rows + F.col("offset")).alias("position")
    return rows.select(*plain.columns, "e.phase", "block", "offset", "e.release", "e.deadline", "e.slot", position)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None) -> DataFrame:
    """docs with __phase, __block, __offset, __release, __deadline, __slot and __position after its own columns.

    weights by source; None: by the square root of the sources' numbers of rows.
    period is taken for older callers and has no effect.
    """
    return _placed(docs, weights, block_rows, docs.count()).toDF(*docs.columns, *(f"__{c}" for c in PLACES))


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, partition_rows: int | None = None) -> DataFrame:
    """docs in the mixed order: partitions are consecutive parts of it, sorted; so are the files written from them.

    partition_rows: rows of a partition; None: as many as have PARTITION_BYTES of text, about.
    """
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if partition_rows is None:
        partition_rows = max(BLOCK_ROWS, min(MOST_ROWS, PARTITION_BYTES * total // max(1, size or 0)))
    rows = _placed(docs, weights, BLOCK_ROWS, total)
    n = max(1, -(-total // partition_rows))
    # positions run to at most block_rows times the blocks: gaps only where a source's last block is short
    part = F.least(F.floor(F.col("position") / partition_rows), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions("position").select(*numbered(docs)[0].columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    rows = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", *(F.col(f"__{c}").cast("long").alias(c) for c in PLACES))
