"""From parsed axioms to the six encoded relations: admission, normal forms, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.dictionary import build_dictionary, encode, seed
from lattica.operators.setops import union_all
from lattica.schemas import TOP_NAME, columns
from lattica.storage import shared_path, written

C = F.col


def admitted() -> Column:
    """Whether an axiom (kind, lhs_kind, rhs_kind, lhs_count) belongs to the profile.

    Side kinds: class, some, value, and, oneof, role, chain, other.
    """
    named = C("rhs_kind") == "class"
    sub = F.when(C("lhs_kind") == "class", C("rhs_kind").isin("class", "some", "value")).when(C("lhs_kind").isin("some", "and"), named).when(C("lhs_kind") == "oneof", named & (C("lhs_count") == 1)).otherwise(False)
    return F.when(C("kind") == "SubClassOf", sub).when(C("kind").isin("SubObjectPropertyOf", "SubPropertyChainOf"), True).when(C("kind") == "ObjectPropertyDomain", named).otherwise(False)


def retain(axioms: DataFrame) -> DataFrame:
    """Admitted axioms of all files, each once."""
    return axioms.where(admitted()).dropDuplicates(["text"])


def retain_stats(axioms: DataFrame) -> DataFrame:
    """How many axioms of each file were kept and skipped."""
    return axioms.groupBy("file").agg(F.count("*").alias("axioms"), F.count_if(admitted()).alias("kept"), F.count_if(~admitted()).alias("skipped"))


def check(axioms: DataFrame) -> DataFrame:
    """The axioms, if all are admitted and flat; else an error that names some of those that are not."""
    bad = [r["text"] for r in axioms.where(~admitted() | C("nested")).select("text").limit(5).collect()]
    if bad:
        raise ValueError(f"unexpected axiom: {'; '.join(bad)}")
    return axioms


def _split(rows: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """(args, sup) with more than two args as steps of two: each but the last gives a new term for its pair.

    Terms are named by what they stand for, so equal beginnings share them.
    """
    step = F.expr(f"""transform(sequence(1, greatest(size(args) - 1, 1)), i -> struct(
        case when i = 1 then args[0] else concat('{prefix}(', array_join(slice(args, 1, i), ' '), ')') end as a,
        case when size(args) = 1 then args[0] else args[i] end as b,
        case when i >= size(args) - 1 then sup else concat('{prefix}(', array_join(slice(args, 1, i + 1), ' '), ')') end as c))""")
    return rows.select(F.explode(step).alias("x")).select(C("x.a").alias(names[0]), C("x.b").alias(names[1]), C("x.c").alias(names[2])).distinct()


def normal_forms(axioms: DataFrame) -> dict[str, DataFrame]:
    """t1 .. t6 with terms. Longer intersections and chains are split with new terms (sound and complete)."""
    sub = axioms.where("kind = 'SubClassOf'")
    first = lambda c: F.element_at(c, 1)
    t1 = sub.where("lhs_kind in ('class', 'oneof') and rhs_kind = 'class'").select(first("lhs_args").alias("subConcept"), first("rhs_args").alias("superConcept"))
    t3 = sub.where("lhs_kind = 'class' and rhs_kind in ('some', 'value')").select(first("lhs_args").alias("subConcept"), C("rhs_role").alias("rhsRole"), first("rhs_args").alias("rhsFiller"))
    t4 = union_all(
        sub.where("lhs_kind = 'some' and rhs_kind = 'class'").select(C("lhs_role").alias("lhsRole"), first("lhs_args").alias("lhsFiller"), first("rhs_args").alias("superConcept")),
        axioms.where("kind = 'ObjectPropertyDomain'").select(C("lhs_role").alias("lhsRole"), F.lit(TOP_NAME).alias("lhsFiller"), first("rhs_args").alias("superConcept")),
    )
    conj = sub.where("lhs_kind = 'and'").select(C("lhs_args").alias("args"), first("rhs_args").alias("sup"))
    chains = axioms.where("kind = 'SubPropertyChainOf'").select(C("lhs_args").alias("args"), C("rhs_role").alias("sup"))
    single = chains.where("size(args) = 1").select(first("args").alias("subRole"), C("sup").alias("superRole"))
    t5 = axioms.where("kind = 'SubObjectPropertyOf'").select(C("lhs_role").alias("subRole"), C("rhs_role").alias("superRole")).unionByName(single)
    return {"t1": t1.distinct(), "t2": _split(conj, columns("t2"), "And"), "t3": t3.distinct(), "t4": t4.distinct(), "t5": t5.distinct(), "t6": _split(chains.where("size(args) > 1"), columns("t6"), "Chain")}


def signature(axioms: DataFrame, named: dict[str, DataFrame]) -> DataFrame:
    """kind (0 concept, 1 role, 2 individual) and term."""
    individuals = union_all(
        axioms.where("lhs_kind = 'oneof'").select(F.explode("lhs_args").alias("term")),
        axioms.where("rhs_kind = 'value'").select(F.explode("rhs_args").alias("term")),
    ).distinct()
    concepts = union_all(*(named[t].select(C(c).alias("term")) for t, cs in {"t1": (0, 1), "t2": (0, 1, 2), "t3": (0, 2), "t4": (1, 2)}.items() for c in (columns(t)[i] for i in cs)))
    declared = axioms.where("kind = 'Declaration' and lhs_kind = 'class'").select(F.explode("lhs_args").alias("term"))
    concepts = concepts.unionByName(declared).distinct().join(individuals, "term", "left_anti")
    roles = union_all(*(named[t].select(C(columns(t)[i]).alias("term")) for t, ix in {"t3": (1,), "t4": (0,), "t5": (0, 1), "t6": (0, 1, 2)}.items() for i in ix)).distinct()
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "term")
    return union_all(kind(concepts, 0), kind(roles, 1), kind(individuals, 2))


def encode_axioms(axioms: DataFrame, seed_individuals: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(s and t1 .. t6 in codes, dictionary). Individuals are coded after roles and seeded only on request."""
    spark: SparkSession = axioms.sparkSession
    declared = axioms.where("kind = 'Declaration'")
    named = normal_forms(check(axioms.where("kind <> 'Declaration'")))
    dictionary = written(build_dictionary(signature(axioms.where("kind <> 'Declaration'").unionByName(declared), named)), shared_path(spark, "dictionary"))
    tables = {k: encode(df, dictionary, columns(k)).select(*columns(k)) for k, df in named.items()}
    seeds = dictionary.where("code <> 1 and kind in (0, 2)" if seed_individuals else "code <> 1 and kind = 0")
    return {"s": seed(seeds), **tables}, dictionary
