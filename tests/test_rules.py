"""Rules and fixpoint on the micro ontology, on edge rows and on random ontologies."""

import inspect
import random

import pytest

from lattica.operators import hierarchy, rules
from lattica.operators.compare import differences, same
from lattica.operators.setops import delta, pair_filter, semi_filter, symmetric, union_distinct
from lattica.plans.closure import classify, classify_naive, close_roles
from lattica.schemas import RELATIONS
from lattica.sources.encoded import from_rows

MICRO = {
    "s": [(i, i) for i in range(2, 10)] + [(i, 1) for i in range(2, 10)],
    "t1": [(2, 3), (2, 4), (9, 7)],
    "t2": [(3, 4, 5)],
    "t3": [(5, 10, 6), (6, 10, 9)],
    "t4": [(12, 7, 8)],
    "t5": [(10, 11)],
    "t6": [(11, 11, 12)],
}
S_NEW = {(2, 3), (2, 4), (2, 5), (2, 8), (5, 8), (9, 7)}
R_ALL = {(10, 2, 6), (10, 5, 6), (10, 6, 9), (11, 2, 6), (11, 5, 6), (11, 6, 9), (12, 2, 9), (12, 5, 9)}


def tables(spark, **rows):
    return {k: from_rows(spark, k, rows.get(k, [])) for k in RELATIONS if k != "r"}


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute(t):
    s, r = set(t["s"]), set()
    while True:
        n = len(s), len(r)
        s |= {(x, b) for x, a in s for c, b in t["t1"] if a == c}
        s |= {(x, b) for x, a in s for c, d, b in t["t2"] if (a == c and (x, d) in s) or (a == d and (x, c) in s)}
        r |= {(q, x, f) for x, a in s for c, q, f in t["t3"] if a == c}
        s |= {(x, b) for q, x, y in r for p, f, b in t["t4"] if p == q and (y, f) in s}
        r |= {(b, x, y) for q, x, y in r for a, b in t["t5"] if a == q}
        r |= {(c, x, z) for p, x, y in r for q, y2, z in r if y == y2 for a, b, c in t["t6"] if a == p and b == q}
        if n == (len(s), len(r)):
            return s, r


@pytest.mark.parametrize("engine", [classify, classify_naive])
def test_micro_closure(spark, engine):
    found = engine(tables(spark, **MICRO))
    s, r = rows(found.s), rows(found.r)
    assert len(s) == len(set(s)) == 22 and set(s) == set(MICRO["s"]) | S_NEW
    assert len(r) == len(set(r)) == 8 and set(r) == R_ALL


def test_stats_and_bound(spark):
    found = classify(tables(spark, **MICRO), max_rounds=1)
    assert len(found.rounds) == 1 and found.stats(spark).count() == 1


@pytest.mark.parametrize("case", [{"t2": [(4, 3, 5)]}, {"t2": [(3, 3, 5)]}, {"t4": []}, {"t2": [], "t6": []}, {"s": MICRO["s"] + MICRO["s"][:3]}, {k: [] for k in MICRO}])
def test_edges_match_brute_force(spark, case):
    t = {**MICRO, **case}
    found = classify(tables(spark, **t))
    s, r = brute(t)
    assert sorted(rows(found.s)) == sorted(s) and sorted(rows(found.r)) == sorted(r)


@pytest.mark.parametrize("seed", range(3))
def test_random_ontologies(spark, seed):
    rnd = random.Random(seed)
    c, q = (lambda: rnd.randint(2, 9)), (lambda: rnd.randint(20, 23))
    t = {"s": [(i, j) for i in range(2, 10) for j in (i, 1)], "t1": [(c(), c()) for _ in range(5)], "t2": [(c(), c(), c()) for _ in range(4)], "t3": [(c(), q(), c()) for _ in range(5)], "t4": [(q(), c(), c()) for _ in range(4)], "t5": [(q(), q()) for _ in range(3)], "t6": [(q(), q(), q()) for _ in range(2)]}
    s, r = brute(t)
    found = classify(tables(spark, **t))
    assert sorted(rows(found.s)) == sorted(s) and sorted(rows(found.r)) == sorted(r)
    again = classify({**tables(spark, **t), "s": found.s}, r=found.r)
    assert same(again.s, found.s) and same(again.r, found.r)


def test_chain_composes_in_order(spark):
    r = from_rows(spark, "r", [(31, 1, 2), (32, 2, 3)])
    t6 = from_rows(spark, "t6", [(31, 32, 33)])
    assert rows(rules.rule6(r, r, t6)) == [(33, 1, 3)]
    assert rows(rules.rule6(r, r, from_rows(spark, "t6", [(32, 31, 33)]))) == []
    assert set(rows(rules.rule6_delta(r, r, t6))) == {(33, 1, 3)}


def test_plans_agree(spark):
    t = tables(spark, **MICRO)
    found = classify(t)
    s, r = found.s, found.r
    assert len({tuple(sorted(set(rows(rules.rule2(s, s, t["t2"], p))))) for p in ("axiom_first", "second_first", "self_join")}) == 1
    assert len({tuple(sorted(set(rows(rules.rule4(s, r, t["t4"], p))))) for p in ("filler_first", "role_first", "pair_first")}) == 1
    assert len({tuple(sorted(set(rows(rules.rule6(r, r, t["t6"], p))))) for p in ("role_first", "pair_first")}) == 1
    for f, args in ((rules.rule2, (s, s, t["t2"])), (rules.rule4, (s, r, t["t4"])), (rules.rule6, (r, r, t["t6"]))):
        with pytest.raises(ValueError):
            f(*args, plan="none")


def test_set_operators(spark):
    s = from_rows(spark, "s", [(2, 3), (2, 3), (4, 5)])
    assert sorted(rows(union_distinct(s, s))) == [(2, 3), (4, 5)]
    assert rows(delta(s, from_rows(spark, "s", [(2, 3)]))) == [(4, 5)]
    t2 = from_rows(spark, "t2", [(1, 2, 3), (4, 4, 5)])
    assert sorted(rows(symmetric(t2))) == [(1, 2, 3), (2, 1, 3), (4, 4, 5)]
    assert sorted(rows(semi_filter(s, "superConcept", from_rows(spark, "t4", [(9, 3, 1)]), "lhsFiller"))) == [(2, 3), (2, 3)]
    pairs = spark.createDataFrame([(2, 1), (1, 4)], "a long, b long")
    assert rows(pair_filter(pairs, "a", "b", t2)) == [(2, 1)]


def test_hierarchy_and_diff(spark):
    s = from_rows(spark, "s", [(i, i) for i in range(1, 6)] + [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (1, 4), (1, 5)])
    assert sorted(rows(hierarchy.equivalents(s))) == [(4, 5), (5, 4)]
    assert sorted(rows(hierarchy.direct_supers(s))) == [(1, 2), (1, 4), (1, 5), (2, 3)]
    assert [r.supers for r in hierarchy.superset_view(s).orderBy("subConcept").collect()][0] == [1, 2, 3, 4, 5]
    other = from_rows(spark, "s", [(1, 1), (9, 9)])
    assert {(r.subConcept, r.side) for r in differences(s.where("subConcept = superConcept and subConcept < 3"), other).collect()} == {(2, "extra"), (9, "missing")}


def test_roles_close(spark):
    t5 = from_rows(spark, "t5", [(i, i + 1) for i in range(1, 9)])
    assert len(rows(close_roles(t5))) == 36


def test_plan_does_not_grow(spark, monkeypatch):
    """A chain needs many rounds; the delta's plan has one size in all of them."""
    sizes = []
    import lattica.plans.closure as closure

    original = closure.delta
    monkeypatch.setattr(closure, "delta", lambda new, known: sizes.append(original(new, known)._jdf.queryExecution().optimizedPlan().toString().count("\n")) or original(new, known))
    n = 7
    found = closure.classify(tables(spark, s=[(i, i) for i in range(2, 2 + n)], t1=[(i, i + 1) for i in range(2, 1 + n)]))
    assert len(rows(found.s)) == n * (n + 1) // 2
    of_s = sizes[0::2]
    assert max(of_s[2:]) <= of_s[1] + 2


def test_bound_of_rounds_is_not_silent(spark):
    """Without a bound a chain is followed to its end; a bound that cuts it says so."""
    chain = tables(spark, s=[(2, 2)], t1=[(k, k + 1) for k in range(2, 7)])
    with pytest.warns(RuntimeWarning, match="max_rounds=2"):
        assert classify(chain, max_rounds=2).s.count() < 6
    assert inspect.signature(classify).parameters["max_rounds"].default is None
