"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes in an Arrow batch, as texts may be long: bounds a Python worker's memory.
BATCH_BYTES = "2m"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_of_stage: list[DataFrame] | None = None
_last_stage: list[DataFrame] = []


def prepare(spark: SparkSession) -> None:
    """Make this package importable on executors and bound the Arrow batches of texts."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp()) / "lattica_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "lattica").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lattica-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/lattica-{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Of queries that are made and run within it, shuffle files go at their end. Else they stay until the driver collects its garbage, which may be late."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def table(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage with a table in the shared folder: a lost executor costs nothing of what is written."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    with shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path, out._lattica_paths = path, [path]
    if _of_stage is not None:
        _of_stage.append(out)
    return out


def paths_read(df: DataFrame) -> set[str]:
    """The paths that a DataFrame reads its rows from, itself and what it is made of."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(k).toUri().getPath() for k in range(roots.size())}
    return out


@contextlib.contextmanager
def stage_of_pipeline(docs: DataFrame) -> Iterator[None]:
    """Within it, tables are noted. When the next stage begins, they go, but for those that its input still reads.

    So stages can be put together without writing what is between them; the result of a
    stage that is not handed on has to be read or written before another stage begins.
    """
    global _of_stage
    still = paths_read(docs)
    kept = []
    for df in _last_stage:
        if urlparse(df._lattica_path).path in still:
            kept.append(df)
        else:
            forget(df)
    _last_stage[:] = kept
    _of_stage = []
    try:
        yield
    finally:
        _last_stage.extend(_of_stage)
        _of_stage = None


def forget(df: DataFrame) -> None:
    """Remove a table() that no later result reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lattica_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if _of_stage is not None:
        _of_stage[:] = [x for x in _of_stage if x is not df]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


#: What a Python worker keeps between tasks, by operator, and how to let go of it.
worker_caches: dict[str, Callable[[], None]] = {}


def free_caches(keep: str | None = None) -> None:
    """At a task's start: workers are used again, and should not hold what another operator kept in them."""
    for name, clear in worker_caches.items():
        if name != keep:
            clear()


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., and these names by docs' own, which may hold dots or clash with a helper's."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, keep: str | None = None) -> DataFrame:
    """mapInArrow with a function of one batch; keep names the worker cache that it uses."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches(keep)
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(each, schema)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: Words of 64 slots of near_ids: an upper bound of the rows that it broadcasts.
WORDS = 1 << 20


def near_ids(docs: DataFrame, ids: DataFrame, inside: bool = True, on: str = "doc_id") -> DataFrame:
    """Rows of docs whose doc_id (or other column `on`) falls into a slot that one of `ids` falls into, or else the others.

    A superset of the rows with these ids, without a shuffle of docs: what is
    broadcast is words of slots, WORDS of them at most however many ids there are.
    A row whose id is none of them falls into one's slot with a probability of
    n / (64 WORDS) for n ids: 4 % for 2.8 million.
    """
    word = F.pmod(F.xxhash64(F.col(on)), F.lit(WORDS))
    # bits of the hash that do not choose the word
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(F.col(on)), 58).cast("int"))
    words = ids.select(word.alias("lattica_slot_word"), bit.alias("lattica_slots")).groupBy("lattica_slot_word").agg(F.bit_or("lattica_slots").alias("lattica_slots"))
    return docs.join(F.broadcast(words), (word == F.col("lattica_slot_word")) & (F.col("lattica_slots").bitwiseAND(bit) != 0), "left_semi" if inside else "left_anti")
