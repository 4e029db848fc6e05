"""An ontology derived from commerce tables: what queries and the bench run on."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.dictionary import build_dictionary, encode, seed
from lattica.operators.setops import union_all, union_distinct
from lattica.schemas import columns
from lattica.storage import shared_path, written


def _name(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


class _Written(Mapping):
    def __init__(self, of: Commerce) -> None:
        self.of, self.done = of, {}

    def __getitem__(self, relation: str) -> DataFrame:
        if relation not in self.done:
            self.done[relation] = written(self.of.lazy(relation), shared_path(self.of.spark, relation))
        return self.done[relation]

    def __iter__(self) -> Iterator[str]:
        return iter(("s", *self.of.named))

    def __len__(self) -> int:
        return 1 + len(self.of.named)


@dataclass
class Commerce:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def named(self) -> dict[str, DataFrame]:
        """t1 .. t6 with terms in place of codes."""
        customer, supplier, part, nation, region = (self.read(t) for t in ("customer", "supplier", "part", "nation", "region"))
        seg, brand, kind = _name("Seg:", "c_mktsegment"), _name("B:", "p_brand"), _name("T:", "p_type")
        pairs = lambda df, a, b: df.select(a.alias("subConcept"), b.alias("superConcept"))
        t1 = union_distinct(
            pairs(customer, _name("C:", "c_custkey"), seg),
            pairs(part, _name("P:", "p_partkey"), brand),
            pairs(part, _name("P:", "p_partkey"), kind),
            pairs(customer, seg, F.lit("Party")),
            pairs(part, brand, F.lit("Product")),
            pairs(part, kind, F.lit("Product")),
        )
        # segments and regions are few by their nature: their pairs are axioms, one for each
        segments = customer.select("c_mktsegment").distinct().withColumn("k", F.lit(1))
        regions = region.select("r_name").distinct().withColumn("k", F.lit(1))
        t2 = segments.join(regions, "k").select(seg.alias("leftConjunct1"), _name("Regional:", "r_name").alias("leftConjunct2"), F.concat(F.lit("Target:"), "c_mktsegment", F.lit("/"), "r_name").alias("superConcept"))
        at = lambda df, key, sub: df.join(nation, F.col(key) == F.col("n_nationkey")).select(sub.alias("subConcept"), F.lit("basedIn").alias("rhsRole"), _name("N:", "n_name").alias("rhsFiller"))
        part_of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(_name("N:", "n_name").alias("subConcept"), F.lit("partOf").alias("rhsRole"), _name("R:", "r_name").alias("rhsFiller"))
        t3 = union_distinct(at(customer, "c_nationkey", _name("C:", "c_custkey")), at(supplier, "s_nationkey", _name("S:", "s_suppkey")), part_of)
        t4 = region.select(F.lit("locatedIn").alias("lhsRole"), _name("R:", "r_name").alias("lhsFiller"), _name("Regional:", "r_name").alias("superConcept")).distinct()
        one = self.spark.range(1)
        t5 = one.select(F.lit("basedIn").alias("subRole"), F.lit("locatedIn").alias("superRole"))
        t6 = one.select(F.lit("locatedIn").alias("lhsRole1"), F.lit("partOf").alias("lhsRole2"), F.lit("locatedIn").alias("superRole"))
        return {"t1": t1, "t2": t2, "t3": t3, "t4": t4, "t5": t5, "t6": t6}

    @cached_property
    def terms(self) -> DataFrame:
        """kind (0 concept, 1 role) and term of all axioms."""
        n = self.named
        of = {0: [("t1", "subConcept"), ("t1", "superConcept"), ("t2", "leftConjunct1"), ("t2", "leftConjunct2"), ("t2", "superConcept"), ("t3", "subConcept"), ("t3", "rhsFiller"), ("t4", "lhsFiller"), ("t4", "superConcept")], 1: [("t3", "rhsRole"), ("t4", "lhsRole"), ("t5", "subRole"), ("t5", "superRole"), ("t6", "lhsRole1"), ("t6", "lhsRole2"), ("t6", "superRole")]}
        return union_all(*(n[t].select(F.lit(kind).alias("kind"), F.col(c).alias("term")) for kind, cs in of.items() for t, c in cs)).distinct()

    @cached_property
    def dictionary(self) -> DataFrame:
        return written(build_dictionary(self.terms), shared_path(self.spark, "dictionary"))

    @cached_property
    def tables(self) -> Mapping[str, DataFrame]:
        """s and t1 .. t6 in codes, each written once, when it is first asked for."""
        return _Written(self)

    def lazy(self, relation: str) -> DataFrame:
        """One encoded relation, without the others."""
        if relation == "s":
            return seed(self.dictionary.where("kind = 0 and code <> 1"))
        return encode(self.named[relation], self.dictionary, columns(relation)).select(*columns(relation))
