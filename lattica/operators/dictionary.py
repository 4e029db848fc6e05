"""Codes of terms: build, encode, decode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.schemas import ROLE_COLUMNS, TOP, TOP_NAME
from lattica.storage import shared_path, written


def build_dictionary(terms: DataFrame) -> DataFrame:
    """code, term, kind: Top is 1, the others follow in the order of (kind, term).

    terms: kind, term. Numbers are given without sorting all rows in one task:
    rows are dealt by range, numbered in their partition, and moved on by the
    sizes of the partitions before it.
    """
    spark = terms.sparkSession
    rows = terms.where(F.col("term") != TOP_NAME).select("kind", "term").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(rows.repartitionByRange(n, "kind", "term").withColumn("part", F.spark_partition_id()), shared_path(spark, "terms"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("kind", "term"))
    coded = parts.withColumn("number", number).join(F.broadcast(before), "part").select((F.lit(TOP) + F.col("before") + F.col("number")).cast("long").alias("code"), "term", "kind")
    return spark.createDataFrame([(TOP, TOP_NAME, 0)], coded.schema).unionByName(coded)


def _words(dictionary: DataFrame, column: str) -> DataFrame:
    """The part of a dictionary that a column takes its terms from.

    A role column has few values, on which a shuffled join would gather nearly all rows;
    roles alone are small enough for Spark to send them to every task by itself.
    """
    return dictionary.where("kind = 1") if column in ROLE_COLUMNS and "kind" in dictionary.columns else dictionary


def encode(df: DataFrame, dictionary: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Terms in the columns replaced by codes. A term without a code is an error, or with strict=False its row is left out."""
    for c in columns:
        side = _words(dictionary, c).select(F.col("term").alias("__t"), F.col("code").alias("__c"))
        joined = df.join(side, F.col(c) == F.col("__t"), "left" if strict else "inner")
        code = F.coalesce("__c", F.raise_error(F.concat(F.lit("no code for term "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("long")) if strict else F.col("__c")
        df = joined.withColumn(c, code).drop("__t", "__c")
    return df


def decode(df: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """Codes in the columns replaced by terms; a code without a term is an error."""
    for c in columns:
        side = _words(dictionary, c).select(F.col("code").alias("__c"), F.col("term").alias("__t"))
        term = F.coalesce("__t", F.raise_error(F.concat(F.lit("no term for code "), F.col(c).cast("string"))))
        df = df.join(side, F.col(c) == F.col("__c"), "left").withColumn(c, term).drop("__t", "__c")
    return df


def misses(df: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """Distinct terms of a column that have no code."""
    return df.select(F.col(column).alias("term")).distinct().join(dictionary.select("term"), "term", "left_anti")


def seed(concepts: DataFrame) -> DataFrame:
    """S(X) = {X, Top} for every concept code."""
    c = concepts.select(F.col("code").alias("subConcept"))
    return c.select("subConcept", F.explode(F.array_distinct(F.array("subConcept", F.lit(TOP).cast("long")))).alias("superConcept"))
