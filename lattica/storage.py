"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if all runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lattica-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_owned: list[list[str]] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/lattica-{tag}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Within it, written tables are noted; at its end they go. What is to last has to be written elsewhere by then."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            remove(spark, path)


def estimated_bytes(df: DataFrame) -> int:
    """The size that the optimizer expects: what it compares with the limit for broadcasts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_all(spark: SparkSession, like: DataFrame, paths: Sequence[str]) -> DataFrame:
    """One scan over several written parts, so that plans do not grow with their number."""
    return spark.read.schema(like.schema).parquet(*paths)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
