"""Differences between two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.dictionary import decode


def missing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows of theirs that ours lacks."""
    return theirs.distinct().join(ours.select(*theirs.columns), theirs.columns, "left_anti")


def extra(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return missing(theirs, ours)


def differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return missing(ours, theirs).withColumn("side", F.lit("missing")).unionByName(extra(ours, theirs).withColumn("side", F.lit("extra")))


def same(ours: DataFrame, theirs: DataFrame) -> bool:
    return differences(ours, theirs).isEmpty()


def named_differences(ours: DataFrame, our_dictionary: DataFrame, theirs: DataFrame, their_dictionary: DataFrame) -> DataFrame:
    """Differences of two results with dictionaries of their own, in terms: what another reasoner found against ours."""
    return differences(decode(ours, our_dictionary, ours.columns), decode(theirs, their_dictionary, theirs.columns))
