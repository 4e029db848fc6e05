"""python -m lattica.cli profile|encode|classify|diff ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.operators.compare import differences, named_differences
from lattica.plans.closure import classify
from lattica.plans.frontend import encode_axioms, retain, retain_stats
from lattica.sources import sinks
from lattica.sources.encoded import load_ontology, read_dictionary, read_text
from lattica.sources.owl import read_functional, write_functional
from lattica.storage import temporary


def profile(spark: SparkSession, source: str, target: str) -> None:
    """Keep the axioms of the profile of one file or a folder of files, merged."""
    axioms = read_functional(spark, source)
    write_functional(retain(axioms), target)
    retain_stats(axioms).show(1000, truncate=False)


def encode(spark: SparkSession, source: str, target: str, seed_individuals: bool = False) -> None:
    with temporary(spark):
        tables, dictionary = encode_axioms(read_functional(spark, source), seed_individuals)
        sinks.write_ontology(tables, target, dictionary)


def classify_folder(spark: SparkSession, source: str, target: str, fmt: str = "txt", single_file: bool = False) -> str:
    """S and R of an encoded ontology; a line of statistics. What it wrote on the way is removed."""
    began = time.perf_counter()
    with temporary(spark):
        found = classify(load_ontology(spark, source, fmt))
        sinks.write_text(found.s, f"{target.rstrip('/')}/sAxioms", single_file)
        sinks.write_text(found.r, f"{target.rstrip('/')}/rAxioms", single_file)
    return f"rounds={len(found.rounds)} partitions={spark.conf.get('spark.sql.shuffle.partitions')} seconds={time.perf_counter() - began:.3f}"


def diff(spark: SparkSession, ours: str, theirs: str, our_dictionary: str | None = None, their_dictionary: str | None = None) -> int:
    """Rows that only one of two results has: by code, or by term if both have a dictionary."""
    a, b = read_text(spark, ours, "s"), read_text(spark, theirs, "s")
    if our_dictionary and their_dictionary:
        found = named_differences(a, read_dictionary(spark, our_dictionary), b, read_dictionary(spark, their_dictionary))
    else:
        found = differences(a, b)
    found.orderBy("side", "subConcept", "superConcept").show(100, truncate=False)
    return found.agg(F.count("*")).first()[0]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lattica", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("profile", "encode", "classify", "diff"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
        if name == "encode":
            p.add_argument("--seed-individuals", action="store_true")
        if name == "diff":
            p.add_argument("--dictionaries", nargs=2, metavar=("OURS", "THEIRS"), default=(None, None))
        if name == "classify":
            p.add_argument("--format", choices=("txt", "json", "parquet"), default="txt")
            p.add_argument("--single-file", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"lattica-{a.command}").getOrCreate()
    if a.command == "profile":
        profile(spark, a.source, a.target)
    elif a.command == "encode":
        encode(spark, a.source, a.target, a.seed_individuals)
    elif a.command == "classify":
        print(classify_folder(spark, a.source, a.target, a.format, a.single_file))
    else:
        return int(diff(spark, a.source, a.target, *a.dictionaries) > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
