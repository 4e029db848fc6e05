"""Set algebra on relations. Relations are sets: what may repeat is made distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def union_distinct(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).dropDuplicates()


def delta(new: DataFrame, known: DataFrame) -> DataFrame:
    """What is new: distinct rows that `known` lacks."""
    return new.dropDuplicates().join(known.select(*new.columns), new.columns, "left_anti")


def flip(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two columns with their values exchanged."""
    return df.withColumns({a: F.col(b), b: F.col(a)})


def symmetric(t2: DataFrame) -> DataFrame:
    """Conjunctions in both orders, each once."""
    return union_distinct(t2, flip(t2, "leftConjunct1", "leftConjunct2"))


def semi_filter(df: DataFrame, column: str, axioms: DataFrame, axiom_column: str) -> DataFrame:
    """Rows whose value in column occurs in an axiom's column; Spark broadcasts the values if they are few."""
    values = axioms.select(F.col(axiom_column).alias(column)).distinct()
    return df.join(values, column, "left_semi").select(*df.columns)


def pair_filter(pairs: DataFrame, a: str, b: str, t2: DataFrame) -> DataFrame:
    """Rows whose pair of values are the conjuncts of an axiom, in either order."""
    both = symmetric(t2.select("leftConjunct1", "leftConjunct2", F.lit(0).cast("long").alias("superConcept")))
    return pairs.join(both.select(F.col("leftConjunct1").alias(a), F.col("leftConjunct2").alias(b)), [a, b], "left_semi").select(*pairs.columns)
