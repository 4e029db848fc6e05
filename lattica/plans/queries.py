"""Queries over the commerce ontology, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import compare, dictionary, hierarchy, rules, setops
from lattica.plans import closure, ontology_queries
from lattica.plans.frontend import admitted
from lattica.plans.workload import Commerce
from lattica.schemas import columns

Query = Callable[[SparkSession, str], DataFrame]


def _named(fn: Callable[[Commerce], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(Commerce(spark, sf_dir))


def _first_r(c: Commerce) -> DataFrame:
    """What rules 3 and 5 give for the seeds."""
    r3 = rules.rule3(c.tables["s"], c.tables["t3"]).distinct()
    return setops.union_distinct(r3, rules.rule5(r3, c.tables["t5"]))


def _second_r(c: Commerce) -> DataFrame:
    r = _first_r(c)
    return setops.union_distinct(r, rules.rule6(r, r, c.tables["t6"]))


def _s_after(c: Commerce) -> DataFrame:
    s1 = setops.union_distinct(c.tables["s"], rules.rule1(c.tables["s"], c.tables["t1"]))
    return setops.union_distinct(s1, rules.rule4(c.tables["s"], _second_r(c), c.tables["t4"]))


def _closure(c: Commerce) -> closure.Closure:
    return closure.classify(c.tables)


def _ontology_stats(c: Commerce) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in c.named.items()]
    parts += [c.terms.groupBy("kind").agg(F.count("*").alias("n")).select(F.when(F.col("kind") == 0, "concepts").otherwise("roles").alias("kind"), "n")]
    return setops.union_all(*parts)


def _closure_stats(c: Commerce) -> DataFrame:
    k = _closure(c)
    s = k.s.agg(F.count("*").alias("n")).select(F.lit("s").alias("part"), F.lit(0).cast("long").alias("role"), "n")
    r = k.r.groupBy("role").agg(F.count("*").alias("n")).select(F.lit("r").alias("part"), "role", "n")
    return s.unionByName(r)


def _superset_view(c: Commerce) -> DataFrame:
    v = hierarchy.superset_view(_closure(c).s)
    return v.select("subConcept", F.size("supers").cast("long").alias("n_supers"), F.array_join(F.transform("supers", lambda x: x.cast("string")), ",").alias("supers"))


def _equivalents(c: Commerce) -> DataFrame:
    """Equivalents after adding brand <= part for parts that are alone in being their brand's smallest: a cycle for each."""
    t1 = c.tables["t1"]
    back = t1.groupBy("superConcept").agg(F.min("subConcept").alias("least"))
    more = back.select(F.col("superConcept").alias("subConcept"), F.col("least").alias("superConcept"))
    return hierarchy.equivalents(closure.subclass_closure(c.tables["s"], setops.union_distinct(t1, more)))


def _theirs(c: Commerce) -> DataFrame:
    """Another result to compare with: without facts on even codes, with a wrong one for each concept."""
    s = c.tables["s"]
    return s.where("subConcept % 2 = 1").unionByName(s.where("subConcept = superConcept").select("subConcept", (F.col("superConcept") + 1000000).alias("superConcept")))


def _profile(c: Commerce) -> DataFrame:
    """Orders as axioms whose shapes come from their columns."""
    o = c.read("orders")
    shape = lambda n, salt: F.element_at(F.array(*(F.lit(x) for x in ("class", "some", "and", "value", "oneof", "other"))), (F.pmod(F.floor(F.col("o_orderkey") / salt), F.lit(n)) + 1).cast("int"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("SubClassOf", "SubObjectPropertyOf", "SubPropertyChainOf", "ObjectPropertyDomain", "EquivalentClasses", "SubClassOf"))), (F.pmod(F.col("o_orderkey"), F.lit(6)) + 1).cast("int"))
    rows = o.select("o_orderkey", kind.alias("kind"), shape(6, 7).alias("lhs_kind"), shape(6, 11).alias("rhs_kind"), (F.pmod(F.col("o_orderkey"), F.lit(3)) + 1).cast("int").alias("lhs_count"))
    return rows.select(F.col("o_orderkey").alias("orderkey"), admitted().alias("allowed"))


def queries() -> dict[str, Query]:
    of = {
        "encode_dictionary": lambda c: c.dictionary.select("code", "term"),
        **{f"encode_type{k}": (lambda k: lambda c: c.lazy(f"t{k}"))(k) for k in range(1, 7)},
        "seed_s": lambda c: c.lazy("s"),
        "rule1_step": lambda c: rules.rule1(c.tables["s"], c.tables["t1"]).distinct(),
        "rule2_step": lambda c: rules.rule2(_s_after(c), _s_after(c), c.tables["t2"]).distinct(),
        "rule2_second_first": lambda c: rules.rule2(_s_after(c), _s_after(c), c.tables["t2"], "second_first").distinct(),
        "rule2_self_join": lambda c: rules.rule2(_s_after(c), _s_after(c), c.tables["t2"], "self_join").distinct(),
        "rule3_step": lambda c: rules.rule3(c.tables["s"], c.tables["t3"]).distinct(),
        "rule4_step": lambda c: rules.rule4(c.tables["s"], _second_r(c), c.tables["t4"]).distinct(),
        "rule4_role_first": lambda c: rules.rule4(c.tables["s"], _second_r(c), c.tables["t4"], "role_first").distinct(),
        "rule4_pair_first": lambda c: rules.rule4(c.tables["s"], _second_r(c), c.tables["t4"], "pair_first").distinct(),
        "rule4_delta": lambda c: rules.rule4_delta(c.tables["s"], c.tables["s"], _second_r(c), _second_r(c), c.tables["t4"]).distinct(),
        "rule5_step": lambda c: rules.rule5(rules.rule3(c.tables["s"], c.tables["t3"]).distinct(), c.tables["t5"]).distinct(),
        "rule6_step": lambda c: rules.rule6(_first_r(c), _first_r(c), c.tables["t6"]).distinct(),
        "rule6_pair_first": lambda c: rules.rule6(_first_r(c), _first_r(c), c.tables["t6"], "pair_first").distinct(),
        "rule6_delta": lambda c: rules.rule6_delta(_first_r(c), _first_r(c), c.tables["t6"]).distinct(),
        "semi_filter_fillers": lambda c: setops.semi_filter(c.tables["s"], "superConcept", c.tables["t4"], "lhsFiller"),
        "semi_filter_roles": lambda c: setops.semi_filter(_first_r(c), "role", c.tables["t6"], "lhsRole1"),
        "pair_filter": lambda c: setops.pair_filter(c.tables["t2"].select(F.col("leftConjunct2").alias("a"), F.col("leftConjunct1").alias("b")), "a", "b", c.tables["t2"]),
        "delta_subtract_s": lambda c: setops.delta(setops.union_all(rules.rule1(c.tables["s"], c.tables["t1"]), c.tables["s"]), c.tables["s"]),
        "delta_subtract_r": lambda c: setops.delta(_second_r(c), _first_r(c)),
        "union_distinct": lambda c: setops.union_distinct(c.tables["s"], c.tables["t1"], c.tables["t1"]),
        "conjunct_flip": lambda c: setops.symmetric(c.tables["t2"]),
        "flip_s": lambda c: setops.flip(c.tables["s"], "subConcept", "superConcept"),
        "subclass_closure": lambda c: closure.subclass_closure(c.tables["s"], c.tables["t1"]),
        "role_closure": lambda c: closure.classify({**c.tables, "t1": c.tables["t1"].limit(0), "t2": c.tables["t2"].limit(0), "t4": c.tables["t4"].limit(0)}).r,
        "closure_s": lambda c: _closure(c).s,
        "closure_r": lambda c: _closure(c).r,
        "closure_naive_s": lambda c: closure.classify_naive(c.tables).s,
        "closure_decoded": lambda c: dictionary.decode(_closure(c).s, c.dictionary, columns("s")),
        "closure_stats": _closure_stats,
        "ontology_stats": _ontology_stats,
        "superset_view": _superset_view,
        "equivalents": _equivalents,
        "direct_supers": lambda c: hierarchy.direct_supers(_closure(c).s),
        "diff_missing": lambda c: compare.missing(c.tables["s"], _theirs(c)),
        "diff_extra": lambda c: compare.extra(c.tables["s"], _theirs(c)),
        "parse_text_roundtrip": lambda c: text.parse_lines(text.format_lines(c.tables["t3"], "t3"), "t3"),
        "json_roundtrip": lambda c: text.from_json_lines(text.to_json_lines(c.tables["t3"], "t3"), "t3"),
        "profile_filter": _profile,
    }
    return {k: _named(fn) for k, fn in {**of, **ontology_queries.queries()}.items()}


_NAMED = """
n1 AS (
  SELECT 'C:' || c_custkey AS a, 'Seg:' || c_mktsegment AS b FROM customer
  UNION SELECT 'P:' || p_partkey, 'B:' || p_brand FROM part
  UNION SELECT 'P:' || p_partkey, 'T:' || p_type FROM part
  UNION SELECT 'Seg:' || c_mktsegment, 'Party' FROM customer
  UNION SELECT 'B:' || p_brand, 'Product' FROM part
  UNION SELECT 'T:' || p_type, 'Product' FROM part),
n2 AS (
  SELECT DISTINCT 'Seg:' || c_mktsegment AS a, 'Regional:' || r_name AS b, 'Target:' || c_mktsegment || '/' || r_name AS c FROM customer, region),
n3 AS (
  SELECT 'C:' || c_custkey AS a, 'basedIn' AS r, 'N:' || n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'S:' || s_suppkey, 'basedIn', 'N:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'N:' || n_name, 'partOf', 'R:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
n4 AS (SELECT DISTINCT 'locatedIn' AS r, 'R:' || r_name AS a, 'Regional:' || r_name AS b FROM region),
terms AS (
  SELECT 0 AS kind, a AS term FROM n1 UNION SELECT 0, b FROM n1
  UNION SELECT 0, a FROM n2 UNION SELECT 0, b FROM n2 UNION SELECT 0, c FROM n2
  UNION SELECT 0, a FROM n3 UNION SELECT 0, b FROM n3
  UNION SELECT 0, a FROM n4 UNION SELECT 0, b FROM n4
  UNION SELECT 1, 'basedIn' UNION SELECT 1, 'locatedIn' UNION SELECT 1, 'partOf'),
dict AS (
  SELECT CAST(1 + row_number() OVER (ORDER BY kind, term) AS BIGINT) AS code, term, kind FROM terms
  UNION ALL SELECT CAST(1 AS BIGINT), 'owl:Thing', 0),
t1 AS (SELECT x.code AS a, y.code AS b FROM n1 JOIN dict x ON n1.a = x.term JOIN dict y ON n1.b = y.term),
t2 AS (SELECT x.code AS a, y.code AS b, z.code AS c FROM n2 JOIN dict x ON n2.a = x.term JOIN dict y ON n2.b = y.term JOIN dict z ON n2.c = z.term),
t3 AS (SELECT x.code AS a, q.code AS r, y.code AS b FROM n3 JOIN dict x ON n3.a = x.term JOIN dict q ON n3.r = q.term JOIN dict y ON n3.b = y.term),
t4 AS (SELECT q.code AS r, x.code AS a, y.code AS b FROM n4 JOIN dict q ON n4.r = q.term JOIN dict x ON n4.a = x.term JOIN dict y ON n4.b = y.term),
t5 AS (SELECT x.code AS a, y.code AS b FROM dict x, dict y WHERE x.term = 'basedIn' AND y.term = 'locatedIn'),
t6 AS (SELECT x.code AS a, y.code AS b, x.code AS c FROM dict x, dict y WHERE x.term = 'locatedIn' AND y.term = 'partOf'),
s AS (SELECT code AS x, code AS a FROM dict WHERE kind = 0 AND code <> 1 UNION SELECT code, CAST(1 AS BIGINT) FROM dict WHERE kind = 0 AND code <> 1)
"""

_STEPS = """,
r3 AS (SELECT DISTINCT t3.r, s.x, t3.b AS y FROM s JOIN t3 ON s.a = t3.a),
r5 AS (SELECT DISTINCT t5.b AS r, x, y FROM r3 JOIN t5 ON r3.r = t5.a),
ra AS (SELECT * FROM r3 UNION SELECT * FROM r5),
r6 AS (SELECT DISTINCT t6.c AS r, p.x, q.y FROM ra p JOIN t6 ON p.r = t6.a JOIN ra q ON q.r = t6.b AND p.y = q.x),
rb AS (SELECT * FROM ra UNION SELECT * FROM r6),
s1 AS (SELECT DISTINCT s.x, t1.b AS a FROM s JOIN t1 ON s.a = t1.a),
s4 AS (SELECT DISTINCT rb.x, t4.b AS a FROM rb JOIN t4 ON rb.r = t4.r JOIN s ON s.x = rb.y AND s.a = t4.a),
sa AS (SELECT * FROM s UNION SELECT * FROM s1 UNION SELECT * FROM s4),
s2 AS (SELECT DISTINCT p.x, t2.c AS a FROM sa p JOIN t2 ON p.a = t2.a JOIN sa q ON q.x = p.x AND q.a = t2.b)
"""

#: All six rules over one relation keyed by its whole row: k is 'U' (a in S(x), stored x, a) or 'R' (x, y in R(r)).
_CLOSURE = """,
f(k, a, b, c, v) USING KEY (k, a, b, c) AS (
  SELECT 'U', x, a, CAST(0 AS BIGINT), 1 FROM s
  UNION
  SELECT k, a, b, c, 1 FROM (
    SELECT 'U' AS k, u.a AS a, t1.b AS b, CAST(0 AS BIGINT) AS c FROM recurring.f u JOIN t1 ON u.b = t1.a WHERE u.k = 'U' AND EXISTS (SELECT 1 FROM f)
    UNION
    SELECT 'U', u.a, t2.c, 0 FROM recurring.f u JOIN t2 ON u.b = t2.a JOIN recurring.f w ON w.k = 'U' AND w.a = u.a AND w.b = t2.b WHERE u.k = 'U' AND EXISTS (SELECT 1 FROM f)
    UNION
    SELECT 'R', t3.r, u.a, t3.b FROM recurring.f u JOIN t3 ON u.b = t3.a WHERE u.k = 'U' AND EXISTS (SELECT 1 FROM f)
    UNION
    SELECT 'U', p.b, t4.b, 0 FROM recurring.f p JOIN t4 ON p.a = t4.r JOIN recurring.f u ON u.k = 'U' AND u.a = p.c AND u.b = t4.a WHERE p.k = 'R' AND EXISTS (SELECT 1 FROM f)
    UNION
    SELECT 'R', t5.b, p.b, p.c FROM recurring.f p JOIN t5 ON p.a = t5.a WHERE p.k = 'R' AND EXISTS (SELECT 1 FROM f)
    UNION
    SELECT 'R', t6.c, p.b, q.c FROM recurring.f p JOIN t6 ON p.a = t6.a JOIN recurring.f q ON q.k = 'R' AND q.a = t6.b AND q.b = p.c WHERE p.k = 'R' AND EXISTS (SELECT 1 FROM f)
  ) n
  WHERE NOT EXISTS (SELECT 1 FROM recurring.f o WHERE o.k = n.k AND o.a = n.a AND o.b = n.b AND o.c = n.c))
"""


def _with(more: str, select: str) -> str:
    return f"WITH {'RECURSIVE ' if 'USING KEY' in more or 'chain' in more else ''}{_NAMED.strip()}{more} {select}"


def oracle_sql() -> dict[str, str]:
    s_cols = "x AS \"subConcept\", a AS \"superConcept\""
    r_cols = "r AS role, x AS \"pairX\", y AS \"pairY\""
    closed_s = "SELECT a AS \"subConcept\", b AS \"superConcept\" FROM f WHERE k = 'U'"
    closed_r = "SELECT a AS role, b AS \"pairX\", c AS \"pairY\" FROM f WHERE k = 'R'"
    chain = ", chain(x, a) AS (SELECT x, a FROM s UNION SELECT chain.x, {t}.b FROM chain JOIN {t} ON chain.a = {t}.a)"
    cycle = ", tc AS (SELECT a, b FROM t1 UNION SELECT b, min(a) FROM t1 GROUP BY b)" + chain.format(t="tc")
    t2_cols = "a AS \"leftConjunct1\", b AS \"leftConjunct2\", c AS \"superConcept\""
    t3_cols = "a AS \"subConcept\", r AS \"rhsRole\", b AS \"rhsFiller\""
    theirs = ", th AS (SELECT x, a FROM s WHERE x % 2 = 1 UNION SELECT x, a + 1000000 FROM s WHERE x = a)"
    shape = "list_extract(['class', 'some', 'and', 'value', 'oneof', 'other'], CAST(floor(o_orderkey / {}) AS BIGINT) % 6 + 1)"
    rule2, rule4, rule6 = (_with(_STEPS, f"SELECT {c} FROM {t}") for c, t in ((s_cols, "s2"), (s_cols, "s4"), (r_cols, "r6")))
    return {
        **ontology_queries.oracle_sql(_with, _STEPS, _with(_CLOSURE, closed_s)),
        "encode_dictionary": _with("", "SELECT code, term FROM dict"),
        "encode_type1": _with("", "SELECT a AS \"subConcept\", b AS \"superConcept\" FROM t1"),
        "encode_type2": _with("", f"SELECT {t2_cols} FROM t2"),
        "encode_type3": _with("", f"SELECT {t3_cols} FROM t3"),
        "encode_type4": _with("", "SELECT r AS \"lhsRole\", a AS \"lhsFiller\", b AS \"superConcept\" FROM t4"),
        "encode_type5": _with("", "SELECT a AS \"subRole\", b AS \"superRole\" FROM t5"),
        "encode_type6": _with("", "SELECT a AS \"lhsRole1\", b AS \"lhsRole2\", c AS \"superRole\" FROM t6"),
        "seed_s": _with("", f"SELECT {s_cols} FROM s"),
        "rule1_step": _with(_STEPS, f"SELECT {s_cols} FROM s1"),
        "rule2_step": rule2,
        "rule2_second_first": rule2,
        "rule2_self_join": rule2,
        "rule3_step": _with(_STEPS, f"SELECT {r_cols} FROM r3"),
        "rule4_step": rule4,
        "rule4_role_first": rule4,
        "rule4_pair_first": rule4,
        "rule4_delta": rule4,
        "rule5_step": _with(_STEPS, f"SELECT {r_cols} FROM r5"),
        "rule6_step": rule6,
        "rule6_pair_first": rule6,
        "rule6_delta": rule6,
        "semi_filter_fillers": _with("", f"SELECT {s_cols} FROM s WHERE EXISTS (SELECT 1 FROM t4 WHERE t4.a = s.a)"),
        "semi_filter_roles": _with(_STEPS, f"SELECT {r_cols} FROM ra WHERE EXISTS (SELECT 1 FROM t6 WHERE t6.a = ra.r)"),
        "pair_filter": _with("", "SELECT b AS a, a AS b FROM t2"),
        "delta_subtract_s": _with(_STEPS, f"SELECT {s_cols} FROM (SELECT * FROM s1 EXCEPT SELECT * FROM s)"),
        "delta_subtract_r": _with(_STEPS, f"SELECT {r_cols} FROM (SELECT * FROM rb EXCEPT SELECT * FROM ra)"),
        "union_distinct": _with("", f"SELECT {s_cols} FROM (SELECT x, a FROM s UNION SELECT a, b FROM t1)"),
        "conjunct_flip": _with("", f"SELECT {t2_cols} FROM (SELECT a, b, c FROM t2 UNION SELECT b, a, c FROM t2)"),
        "flip_s": _with("", "SELECT a AS \"subConcept\", x AS \"superConcept\" FROM s"),
        "subclass_closure": _with(chain.format(t="t1"), f"SELECT {s_cols} FROM chain"),
        "role_closure": _with(_STEPS, f"SELECT {r_cols} FROM rb"),
        "closure_s": _with(_CLOSURE, closed_s),
        "closure_r": _with(_CLOSURE, closed_r),
        "closure_naive_s": _with(_CLOSURE, closed_s),
        "closure_decoded": _with(_CLOSURE, "SELECT p.term AS \"subConcept\", q.term AS \"superConcept\" FROM f JOIN dict p ON f.a = p.code JOIN dict q ON f.b = q.code WHERE f.k = 'U'"),
        "closure_stats": _with(_CLOSURE, "SELECT 's' AS part, CAST(0 AS BIGINT) AS role, count(*) AS n FROM f WHERE k = 'U' UNION ALL SELECT 'r', a, count(*) FROM f WHERE k = 'R' GROUP BY a"),
        "ontology_stats": _with("", " UNION ALL ".join(f"SELECT 't{k}' AS kind, count(*) AS n FROM t{k}" for k in range(1, 7)) + " UNION ALL SELECT CASE kind WHEN 0 THEN 'concepts' ELSE 'roles' END, count(*) FROM terms GROUP BY kind"),
        "superset_view": _with(_CLOSURE, "SELECT a AS \"subConcept\", count(*) AS n_supers, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS supers FROM f WHERE k = 'U' GROUP BY a"),
        "equivalents": _with(cycle, f"SELECT {s_cols} FROM chain c WHERE x <> a AND EXISTS (SELECT 1 FROM chain d WHERE d.x = c.a AND d.a = c.x)"),
        "direct_supers": _with(_CLOSURE + ", p AS (SELECT a AS x, b AS a FROM f u WHERE k = 'U' AND a <> b AND NOT EXISTS (SELECT 1 FROM f w WHERE w.k = 'U' AND w.a = u.b AND w.b = u.a))", f"SELECT {s_cols} FROM p WHERE NOT EXISTS (SELECT 1 FROM p m JOIN p n ON m.a = n.x WHERE m.x = p.x AND n.a = p.a)"),
        "diff_missing": _with(theirs, f"SELECT {s_cols} FROM (SELECT * FROM th EXCEPT SELECT * FROM s)"),
        "diff_extra": _with(theirs, f"SELECT {s_cols} FROM (SELECT * FROM s EXCEPT SELECT * FROM th)"),
        "parse_text_roundtrip": _with("", f"SELECT {t3_cols} FROM t3"),
        "json_roundtrip": _with("", f"SELECT {t3_cols} FROM t3"),
        "profile_filter": f"""
WITH o AS (
  SELECT o_orderkey, o_orderkey % 3 + 1 AS n, {shape.format(7)} AS l, {shape.format(11)} AS h,
         list_extract(['SubClassOf', 'SubObjectPropertyOf', 'SubPropertyChainOf', 'ObjectPropertyDomain', 'EquivalentClasses', 'SubClassOf'], o_orderkey % 6 + 1) AS k
  FROM orders)
SELECT o_orderkey AS orderkey,
       CASE k WHEN 'SubObjectPropertyOf' THEN true WHEN 'SubPropertyChainOf' THEN true
              WHEN 'ObjectPropertyDomain' THEN h = 'class'
              WHEN 'SubClassOf' THEN (l = 'class' AND h IN ('class', 'some', 'value')) OR (l IN ('some', 'and') AND h = 'class') OR (l = 'oneof' AND h = 'class' AND n = 1)
              ELSE false END AS allowed
FROM o""",
    }
