"""The six completion rules as joins.

s: subConcept, superConcept. r: role, pairX, pairY. A rule's result has the
columns of s or r and may repeat rows: the fixpoint makes them distinct once a
round. Given deltas for s or r, a linear rule yields what follows from these.
The `plan` of a rule picks one of several join orders with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.setops import pair_filter, semi_filter, symmetric, union_all

C = F.col


def _s(df: DataFrame, alias: str) -> DataFrame:
    return df.select(C("subConcept").alias(f"{alias}_sub"), C("superConcept").alias(f"{alias}_sup"))


def _r(df: DataFrame, alias: str) -> DataFrame:
    return df.select(C("role").alias(f"{alias}_role"), C("pairX").alias(f"{alias}_x"), C("pairY").alias(f"{alias}_y"))


def _s_out(df: DataFrame, sub: str, sup: str) -> DataFrame:
    return df.select(C(sub).alias("subConcept"), C(sup).alias("superConcept"))


def _r_out(df: DataFrame, role: str, x: str, y: str) -> DataFrame:
    return df.select(C(role).alias("role"), C(x).alias("pairX"), C(y).alias("pairY"))


def rule1(s: DataFrame, t1: DataFrame) -> DataFrame:
    """A in S(X), A <= B: B in S(X)."""
    j = _s(s, "s").join(_s(t1, "t"), C("s_sup") == C("t_sub"))
    return _s_out(j, "s_sub", "t_sup")


def rule2(s_new: DataFrame, s: DataFrame, t2: DataFrame, plan: str = "axiom_first") -> DataFrame:
    """A1 and A2 in S(X), A1 and A2 <= B: B in S(X); at least one of the two from s_new.

    axiom_first, second_first: s_new with one conjunct, then s with the other;
    self_join: pairs of S(X) that are conjuncts, quadratic in |S(X)|.
    """
    t = symmetric(t2).select(C("leftConjunct1").alias("c1"), C("leftConjunct2").alias("c2"), C("superConcept").alias("b"))
    a, o = _s(s_new, "a"), _s(s, "o")
    if plan == "axiom_first":
        j = a.join(t, C("a_sup") == C("c1")).join(o, (C("a_sub") == C("o_sub")) & (C("c2") == C("o_sup")))
    elif plan == "second_first":
        j = o.join(t, C("o_sup") == C("c2")).join(a, (C("a_sub") == C("o_sub")) & (C("c1") == C("a_sup")))
    elif plan == "self_join":
        pairs = pair_filter(a.join(o, C("a_sub") == C("o_sub")), "a_sup", "o_sup", t2)
        j = pairs.join(t, (C("a_sup") == C("c1")) & (C("o_sup") == C("c2")))
    else:
        raise ValueError(plan)
    return _s_out(j, "a_sub", "b")


def rule3(s: DataFrame, t3: DataFrame) -> DataFrame:
    """A in S(X), A <= some r B: (X, B) in R(r)."""
    j = _s(s, "s").join(t3.select(C("subConcept").alias("a"), "rhsRole", "rhsFiller"), C("s_sup") == C("a"))
    return _r_out(j, "rhsRole", "s_sub", "rhsFiller")


def rule4(s: DataFrame, r: DataFrame, t4: DataFrame, plan: str = "filler_first") -> DataFrame:
    """(X, Y) in R(r), A in S(Y), some r A <= B: B in S(X).

    filler_first: s with axioms, then pairs on role and Y; role_first: pairs with
    axioms, then s on Y and filler; pair_first: pairs with s, then axioms on both;
    filler_then_pair: s with axioms, then pairs on Y, of which those of the role stay.
    """
    t = t4.select(C("lhsRole").alias("t_role"), C("lhsFiller").alias("t_filler"), C("superConcept").alias("b"))
    a, p = _s(s, "a"), _r(r, "p")
    role, filler, pair = C("p_role") == C("t_role"), C("a_sup") == C("t_filler"), C("p_y") == C("a_sub")
    if plan == "filler_first":
        j = a.join(t, filler).join(p, role & pair)
    elif plan == "role_first":
        j = p.join(t, role).join(a, pair & filler)
    elif plan == "pair_first":
        j = p.join(a, pair).join(t, role & filler)
    elif plan == "filler_then_pair":
        j = a.join(t, filler).join(p, pair).where(role)
    else:
        raise ValueError(plan)
    return _s_out(j, "p_x", "b")


def rule4_delta(s_new: DataFrame, s: DataFrame, r_new: DataFrame, r: DataFrame, t4: DataFrame) -> DataFrame:
    """Rule 4 for what is new on either side.

    New pairs meet s on Y, of which only fillers of axioms are left, and then axioms on
    role and filler: role alone would multiply the pairs of a role by its axioms.
    """
    fillers = semi_filter(s, "superConcept", t4, "lhsFiller")
    return union_all(rule4(s_new, r, t4), rule4(fillers, r_new, t4, "pair_first"))


def rule5(r: DataFrame, t5: DataFrame) -> DataFrame:
    """(X, Y) in R(r), r <= s: (X, Y) in R(s)."""
    j = _r(r, "p").join(t5, C("p_role") == C("subRole"))
    return _r_out(j, "superRole", "p_x", "p_y")


def rule6(r_first: DataFrame, r_second: DataFrame, t6: DataFrame, plan: str = "role_first") -> DataFrame:
    """(X, Y) in R(r1), (Y, Z) in R(r2), r1 o r2 <= r3: (X, Z) in R(r3).

    role_first: first pairs with axioms, then second pairs on role and Y;
    pair_first: pairs on Y, then axioms on both roles.
    """
    a, b = _r(r_first, "a"), _r(r_second, "b")
    first, second, meet = C("a_role") == C("lhsRole1"), C("b_role") == C("lhsRole2"), C("a_y") == C("b_x")
    if plan == "role_first":
        j = a.join(t6, first).join(b, second & meet)
    elif plan == "pair_first":
        j = a.join(b, meet).join(t6, first & second)
    else:
        raise ValueError(plan)
    return _r_out(j, "superRole", "a_x", "b_y")


def rule6_delta(r_new: DataFrame, r: DataFrame, t6: DataFrame) -> DataFrame:
    """Rule 6 for what is new on either side: new o all, all o new."""
    return union_all(rule6(r_new, r, t6), rule6(r, r_new, t6))
