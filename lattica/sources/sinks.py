"""Results as text, JSON or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.schemas import RELATIONS


def _one_or_many(df: DataFrame, single_file: bool) -> DataFrame:
    # one file is for small results that other programs read; large ones are written by all tasks
    return df.coalesce(1) if single_file else df


def write_text(df: DataFrame, path: str, single_file: bool = False) -> None:
    _one_or_many(df, single_file).write.mode("overwrite").option("sep", "|").csv(path)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    _one_or_many(df, single_file).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_dictionary(dictionary: DataFrame, path: str, single_file: bool = False) -> None:
    lines = dictionary.select(F.concat_ws("|", F.col("code").cast("string"), "term").alias("value"))
    _one_or_many(lines, single_file).write.mode("overwrite").text(path)


def write_ontology(tables: dict[str, DataFrame], folder: str, dictionary: DataFrame | None = None) -> None:
    """Every relation as text and as JSON, empty ones too, and the dictionary."""
    for name, df in tables.items():
        stem = RELATIONS[name][0]
        write_text(df, f"{folder.rstrip('/')}/{stem}.txt")
        write_json(df, f"{folder.rstrip('/')}/{stem}.json")
    if dictionary is not None:
        write_dictionary(dictionary, f"{folder.rstrip('/')}/dictionary.txt")


def show(df: DataFrame, rows: int = 20) -> None:
    """A first look on the console; nothing but these rows reaches the driver."""
    df.show(rows, truncate=False)
