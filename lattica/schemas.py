"""Relations: column names in file order; every column is a long."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Relation -> (file stem, columns).
RELATIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "s": ("sAxioms", ("subConcept", "superConcept")),
    "t1": ("Type1Axioms", ("subConcept", "superConcept")),
    "t2": ("Type2Axioms", ("leftConjunct1", "leftConjunct2", "superConcept")),
    "t3": ("Type3Axioms", ("subConcept", "rhsRole", "rhsFiller")),
    "t4": ("Type4Axioms", ("lhsRole", "lhsFiller", "superConcept")),
    "t5": ("Type5Axioms", ("subRole", "superRole")),
    "t6": ("Type6Axioms", ("lhsRole1", "lhsRole2", "superRole")),
    "r": ("rAxioms", ("role", "pairX", "pairY")),
}

#: Columns that hold roles.
ROLE_COLUMNS = frozenset(("role", "rhsRole", "lhsRole", "subRole", "superRole", "lhsRole1", "lhsRole2"))

#: Code and name of the concept that holds all others.
TOP, TOP_NAME = 1, "owl:Thing"

DICTIONARY = StructType([StructField("code", LongType(), False), StructField("term", StringType(), False)])


def columns(relation: str) -> list[str]:
    return list(RELATIONS[relation][1])


def schema(relation: str) -> StructType:
    return StructType([StructField(c, LongType(), False) for c in columns(relation)])
