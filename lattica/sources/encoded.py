"""Encoded axiom files, text or JSON, from any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.schemas import RELATIONS, schema


def _at(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def read_text(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """Lines of integers separated by |; anything else is an error."""
    return spark.read.schema(schema(relation)).option("sep", "|").option("mode", "FAILFAST").csv(path)


def read_json(spark: SparkSession, path: str, relation: str) -> DataFrame:
    return spark.read.schema(schema(relation)).option("mode", "FAILFAST").json(path).alias(relation)


def read_parquet(spark: SparkSession, path: str, relation: str) -> DataFrame:
    return spark.read.schema(schema(relation)).parquet(path)


_READERS = {"txt": read_text, "json": read_json, "parquet": read_parquet}


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], schema(relation))


def from_rows(spark: SparkSession, relation: str, rows: list[tuple[int, ...]]) -> DataFrame:
    return spark.createDataFrame(rows, schema(relation))


def load_ontology(spark: SparkSession, folder: str, fmt: str = "txt") -> dict[str, DataFrame]:
    """s and t1 .. t6 of a folder; nothing is cached here, as each is read once for each rule that uses it."""
    return {k: _READERS[fmt](spark, _at(folder, f"{stem}.{fmt}"), k) for k, (stem, _) in RELATIONS.items() if k != "r"}


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """code|term; a term may hold | itself."""
    lines = spark.read.text(path)
    code = F.regexp_extract("value", r"^(\d+)\|", 1).cast("long")
    return lines.select(code.alias("code"), F.regexp_replace("value", r"^\d+\|", "").alias("term"))
