"""Views on a closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equivalents(s: DataFrame) -> DataFrame:
    """Pairs of different concepts that hold each other."""
    back = s.select(F.col("superConcept").alias("subConcept"), F.col("subConcept").alias("superConcept"))
    return s.where("subConcept <> superConcept").join(back, ["subConcept", "superConcept"], "left_semi")


def proper_supers(s: DataFrame) -> DataFrame:
    """Super-concepts that are not equivalent."""
    return s.where("subConcept <> superConcept").join(equivalents(s), ["subConcept", "superConcept"], "left_anti")


def direct_supers(s: DataFrame) -> DataFrame:
    """Proper super-concepts with none in between (transitive reduction)."""
    p = proper_supers(s)
    lower = p.select(F.col("subConcept"), F.col("superConcept").alias("mid"))
    upper = p.select(F.col("subConcept").alias("mid"), "superConcept")
    return p.join(lower.join(upper, "mid").select("subConcept", "superConcept").distinct(), ["subConcept", "superConcept"], "left_anti")


def superset_view(s: DataFrame) -> DataFrame:
    """Each concept with the sorted array of its super-concepts."""
    return s.groupBy("subConcept").agg(F.array_sort(F.collect_set("superConcept")).alias("supers"))
