"""The fixpoint of the six rules.

Semi-naive: a round applies every rule to what the round before found (and all
that is known on the other side), takes away what is known, and writes the rest
as a part of its own. S and R are one scan over the parts so far, so the plan of
a round does not grow with its number, and a lost executor costs no earlier
round; after MOST_PARTS parts the older ones become one. The loop ends when a
round finds nothing. From round DEEP on, sub-concept chains are followed by
doubling steps, so a hierarchy of any depth takes few rounds.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import rules
from lattica.operators.setops import delta, union_all, union_distinct
from lattica.schemas import columns
from lattica.sources.encoded import empty
from lattica.storage import read_all, remove, shared_path, written

#: Rounds that follow sub-concept axioms one by one; parts of a relation that one scan reads.
DEEP, MOST_PARTS = 8, 12


class Parts:
    """A growing relation as written parts."""

    def __init__(self, start: DataFrame, tag: str) -> None:
        self.spark, self.folder, self.count = start.sparkSession, shared_path(start.sparkSession, tag), 0
        self.like, self.paths = start, []
        self.add(start.dropDuplicates())

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.new = written(df, path)
        self.paths.append(path)
        self.count += 1
        return self.new

    @property
    def all(self) -> DataFrame:
        return read_all(self.spark, self.like, self.paths)

    def compact(self) -> None:
        """Many small parts become one; frames that read the old ones must no longer be used."""
        if len(self.paths) > MOST_PARTS:
            old, merged = self.paths[:-1], f"{self.folder}/to{self.count}"
            written(read_all(self.spark, self.like, old), merged)
            self.paths = [merged, self.paths[-1]]
            for path in old:
                remove(self.spark, path)


@dataclass
class Closure:
    s: DataFrame
    r: DataFrame
    #: of each round: number, new rows of s and r, seconds
    rounds: list[tuple[int, int, int, float]] = field(default_factory=list)
    #: False if a bound of rounds ended the loop with new rows in its last round
    complete: bool = True
    #: what s and r are read from, to go on with
    parts: tuple[Parts, Parts] | None = None

    def stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rounds, "round long, new_s long, new_r long, seconds double")


def close_roles(t5: DataFrame) -> DataFrame:
    """Role inclusions with all that follow by transitivity: long hierarchies then cost no rounds."""
    spark = t5.sparkSession
    path = shared_path(spark, "roles")
    known = written(t5.distinct(), f"{path}/0")
    if known.isEmpty():
        return known
    # lengths of paths double, so this ends after the logarithm of the longest one
    for k in count(1):
        step = known.select("subRole", F.col("superRole").alias("mid")).join(known.select(F.col("subRole").alias("mid"), "superRole"), "mid").select("subRole", "superRole")
        new = written(delta(step, known), f"{path}/{k}")
        if new.isEmpty():
            return known
        known = read_all(spark, known, [f"{path}/{i}" for i in range(k + 1)])


class Doubling:
    """Sub-concept axioms composed with themselves: 1, 2, 4, ... steps at once."""

    def __init__(self, t1: DataFrame) -> None:
        self.powers = [t1]

    def power(self, k: int) -> DataFrame:
        while len(self.powers) <= k:
            p = self.powers[-1]
            twice = p.select("subConcept", F.col("superConcept").alias("mid")).join(p.select(F.col("subConcept").alias("mid"), "superConcept"), "mid")
            self.powers.append(written(twice.select("subConcept", "superConcept").distinct(), shared_path(p.sparkSession, "power")))
        return self.powers[k]

    def follow(self, s: DataFrame) -> DataFrame:
        """s with everything that rule 1 gives for it, however many steps away."""
        found = Parts(s, "steps")
        for k in count():
            # so far all within 2^k - 1 steps; if none of 2^k to 2^(k+1) - 1 steps adds to it, none of more does
            if found.add(delta(rules.rule1(found.all, self.power(k)), found.all)).isEmpty():
                return found.all


def _stopped(max_rounds: int | None) -> None:
    warnings.warn(f"stopped after max_rounds={max_rounds} with new facts in the last round: S and R may be incomplete", RuntimeWarning, stacklevel=3)


@contextmanager
def _named(spark: SparkSession, name: str) -> Iterator[None]:
    """Spark's jobs within carry the name."""
    before = spark.sparkContext.getLocalProperty("spark.job.description")
    spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.job.description", before)


def _useful(tables: dict[str, DataFrame]) -> DataFrame:
    """Super-concepts that stand on some axiom's left side: facts with others, as Top mostly is, lead nowhere."""
    left = {"t1": "subConcept", "t3": "subConcept", "t4": "lhsFiller"}
    parts = [tables[k].select(F.col(c).alias("superConcept")) for k, c in left.items()]
    parts += [tables["t2"].select(F.col(c).alias("superConcept")) for c in columns("t2")[:2]]
    return written(union_distinct(*parts), shared_path(tables["t1"].sparkSession, "left"))


def classify(tables: dict[str, DataFrame], max_rounds: int | None = None, preclose_roles: bool = True, r: DataFrame | None = None, known: Closure | None = None, added: dict[str, DataFrame] | None = None, explain: bool = False) -> Closure:
    """S and R of an ontology: s (seed) and t1 .. t6; r, if there are pairs to begin with.

    It goes on until a round finds nothing; a bound that is given ends it earlier, with a
    warning and complete=False. known and added: the closure of the tables without the
    rows in added, from which it goes on with what these give; known is used up by it.
    explain prints the plans of each round.
    """
    spark = tables["s"].sparkSession
    t1, t2, t3, t4, t6 = (tables[k] for k in ("t1", "t2", "t3", "t4", "t6"))
    t5 = close_roles(tables["t5"]) if preclose_roles else tables["t5"]
    left, doubling = _useful(tables), Doubling(t1)
    useful = lambda s: s.join(left, "superConcept", "left_semi").select("subConcept", "superConcept")
    roles_of = lambda new: union_all(new, rules.rule5(new, t5)) if preclose_roles else new
    if known is None:
        begin = empty(spark, "r") if r is None else r
        s, p = Parts(tables["s"], "s"), Parts(roles_of(begin), "r")
    else:
        s, p = known.parts
        _first_of(s, p, added or {}, t5, roles_of)
    out = Closure(s.all, p.all, parts=(s, p))
    has = {k: not tables[k].isEmpty() for k in ("t2", "t4", "t5", "t6")}
    for number in range(1, max_rounds + 1) if max_rounds is not None else count(1):
        began = time.perf_counter()
        ds, dr, all_s, all_r = useful(s.new), p.new, useful(s.all), p.all
        with _named(spark, f"round {number}: steps of chains"):
            found_s = [rules.rule1(ds, t1) if number < DEEP else doubling.follow(ds)]
        found_r = [rules.rule3(ds, t3)]
        if has["t2"]:
            found_s.append(rules.rule2(ds, all_s, t2))
        if has["t4"]:
            found_s.append(rules.rule4_delta(ds, all_s, dr, all_r, t4))
        if has["t6"]:
            found_r.append(rules.rule6_delta(dr, all_r, t6))
        new_r = union_all(*found_r)
        if has["t5"]:
            # with closed roles a pair's other roles follow at once
            new_r = roles_of(new_r) if preclose_roles else union_all(new_r, rules.rule5(dr, t5))
        new_s, new_r = delta(union_all(*found_s), s.all), delta(new_r, p.all)
        if explain:
            new_s.explain("formatted")
            new_r.explain("formatted")
        with _named(spark, f"round {number}: S by rules 1, 2, 4"):
            new_s = s.add(new_s)
        with _named(spark, f"round {number}: R by rules 3, 5, 6"):
            new_r = p.add(new_r)
        counts = new_s.count(), new_r.count()
        out.rounds.append((number, *counts, time.perf_counter() - began))
        if not any(counts):
            break
        s.compact()
        p.compact()
    else:
        out.complete = False
        _stopped(max_rounds)
    out.s, out.r = s.all, p.all
    return out


def _first_of(s: Parts, p: Parts, added: dict[str, DataFrame], t5: DataFrame, roles_of) -> None:
    """What added axioms and facts give at once, as the newest parts."""
    found_s, found_r = [s.like.limit(0)], [p.like.limit(0)]
    if "s" in added:
        found_s.append(added["s"])
    if "t1" in added:
        found_s.append(rules.rule1(s.all, added["t1"]))
    if "t2" in added:
        found_s.append(rules.rule2(s.all, s.all, added["t2"]))
    if "t3" in added:
        found_r.append(rules.rule3(s.all, added["t3"]))
    if "t4" in added:
        found_s.append(rules.rule4(s.all, p.all, added["t4"]))
    if "t5" in added:
        found_r.append(rules.rule5(p.all, t5))
    if "t6" in added:
        found_r.append(rules.rule6(p.all, p.all, added["t6"]))
    s.add(delta(union_all(*found_s), s.all))
    p.add(delta(roles_of(union_all(*found_r)), p.all))


def classify_naive(tables: dict[str, DataFrame], max_rounds: int | None = None) -> Closure:
    """The same by full evaluation of every rule in each round, until the counts stay: what tests compare with."""
    spark = tables["s"].sparkSession
    path = shared_path(spark, "naive")
    s, r = written(tables["s"].dropDuplicates(), f"{path}/s0"), empty(spark, "r")
    out = Closure(s, r)
    before = (s.count(), 0)
    for number in range(1, max_rounds + 1) if max_rounds is not None else count(1):
        began = time.perf_counter()
        s1 = union_distinct(s, rules.rule1(s, tables["t1"]))
        s2 = union_distinct(s1, rules.rule2(s1, s1, tables["t2"]))
        r3 = union_distinct(r, rules.rule3(s2, tables["t3"]))
        s4 = union_distinct(s2, rules.rule4(s2, r3, tables["t4"]))
        r5 = union_distinct(r3, rules.rule5(r3, tables["t5"]))
        r6 = union_distinct(r5, rules.rule6(r5, r5, tables["t6"]))
        s, r = written(s4, f"{path}/s{number}"), written(r6, f"{path}/r{number}")
        now = s.count(), r.count()
        out.rounds.append((number, now[0] - before[0], now[1] - before[1], time.perf_counter() - began))
        if number > 1:
            remove(spark, f"{path}/s{number - 1}")
            remove(spark, f"{path}/r{number - 1}")
        if now == before:
            break
        before = now
    else:
        out.complete = False
        _stopped(max_rounds)
    out.s, out.r = s, r
    return out


def subclass_closure(s: DataFrame, t1: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Rule 1 alone, to the end."""
    spark = s.sparkSession
    names = ("t2", "t3", "t4", "t5", "t6")
    return classify({"s": s, "t1": t1, **{k: empty(spark, k) for k in names}}, max_rounds).s
