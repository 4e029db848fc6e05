"""Scalar forms of the encoded axioms: delimited lines and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.schemas import columns, schema

SEPARATOR = "|"


def format_lines(df: DataFrame, relation: str) -> DataFrame:
    """One column `value`: the relation's numbers joined by the separator."""
    return df.select(F.concat_ws(SEPARATOR, *(F.col(c).cast("string") for c in columns(relation))).alias("value"))


def parse_lines(lines: DataFrame, relation: str) -> DataFrame:
    """The reverse; a line of another width or with anything but integers is an error."""
    names = columns(relation)
    parts = F.split("value", r"\|", -1)
    width = F.when(F.size(parts) != len(names), F.raise_error(F.concat(F.lit(f"{relation}: malformed line: "), "value")))

    def number(i: int) -> Column:
        text = F.get(parts, F.lit(i))
        return F.coalesce(width.cast("long"), text.try_cast("long"), F.raise_error(F.concat(F.lit(f"{relation}: not an integer: "), "value")).cast("long"))

    return lines.select(*(number(i).alias(c) for i, c in enumerate(names)))


def to_json_lines(df: DataFrame, relation: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns(relation))).alias("value"))


def from_json_lines(lines: DataFrame, relation: str) -> DataFrame:
    parsed = F.from_json("value", schema(relation), {"mode": "FAILFAST"})
    return lines.select(parsed.alias("v")).select("v.*")
