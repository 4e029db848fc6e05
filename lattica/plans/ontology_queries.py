"""Queries over the commerce ontology as files: OWL documents, encoded axioms, dictionaries, results."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import compare, rules, setops
from lattica.operators.dictionary import decode
from lattica.plans import closure, frontend
from lattica.plans.workload import Commerce
from lattica.schemas import RELATIONS, columns
from lattica.sources import encoded, owl, sinks
from lattica.storage import shared_path
from lattica.streaming.incremental import Incremental


def _iri(c: Column | str) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def _term(prefix: str, c: str) -> Column:
    return F.concat(F.lit(f"<{prefix}"), F.col(c).cast("string"), F.lit(">"))


def _line(pattern: str, *parts: Column) -> Column:
    """pattern with its {} filled in."""
    out: list[Column] = []
    for k, text in enumerate(pattern.split("{}")):
        out += [F.lit(text), *parts[k : k + 1]]
    return F.concat(*out).alias("text")


def documents(c: Commerce) -> dict[str, DataFrame]:
    """Lines of two documents: the ontology's subsumptions, and its other axioms with all further shapes."""
    n, one = c.named, c.spark.range(1)
    of = lambda t, pattern: n[t].select(_line(pattern, *map(_iri, columns(t))))
    places = c.read("nation").join(c.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier, nation, region = c.read("supplier"), c.read("nation"), c.read("region")
    rest = [
        of("t2", "SubClassOf(ObjectIntersectionOf({} {}) {})"),
        of("t4", "SubClassOf(ObjectSomeValuesFrom({} {}) {})"),
        of("t5", "SubObjectPropertyOf({} {})"),
        of("t6", "SubObjectPropertyOf(ObjectPropertyChain({} {}) {})"),
        places.select(_line("SubClassOf(ObjectIntersectionOf({} {} <Zone>) {})", _term("N:", "n_name"), _term("R:", "r_name"), _term("Market:", "n_name"))),
        one.select(F.lit("SubObjectPropertyOf(ObjectPropertyChain(<basedIn> <partOf> <within>) <reach>)").alias("text")),
        one.select(F.lit("ObjectPropertyDomain(<basedIn> <Party>)").alias("text")),
        supplier.select(_line("SubClassOf({} ObjectHasValue(<ratedBy> {}))", _term("S:", "s_suppkey"), _term("i:", "s_nationkey"))),
        nation.select(_line("SubClassOf(ObjectOneOf({}) <Agency>)", _term("i:", "n_nationkey"))),
        nation.select(_line("EquivalentClasses({} {})", _term("N:", "n_name"), _term("Z:", "n_name"))),
        supplier.select(_line("SubClassOf({} ObjectIntersectionOf(<Party> <Vendor>))", _term("S:", "s_suppkey"))),
        region.select(_line("SubClassOf(ObjectOneOf({} <i:none>) <Agency>)", _term("i:", "r_regionkey"))),
        region.select(_line("Declaration(Class({}))", _term("Lonely:", "r_name"))),
    ]
    return {"large": setops.union_all(of("t1", "SubClassOf({} {})"), of("t3", "SubClassOf({} ObjectSomeValuesFrom({} {}))")), "rest": setops.union_all(*rest)}


def _folder(c: Commerce) -> str:
    """The documents written as files."""
    folder = shared_path(c.spark, "ontology")
    for name, lines in documents(c).items():
        owl.write_functional(lines, f"{folder}/{name}", single_file=name == "rest")
    return folder


def _axioms(c: Commerce, by_line: bool | None = None) -> DataFrame:
    return owl.read_functional(c.spark, f"{_folder(c)}/*", by_line)


def _shapes(axioms: DataFrame) -> DataFrame:
    joined = lambda x: F.array_join(x, ",").alias(x)
    return axioms.select("kind", "lhs_kind", "lhs_role", joined("lhs_args"), "rhs_kind", "rhs_role", joined("rhs_args"), "text")


def _stats(c: Commerce) -> DataFrame:
    found = frontend.retain_stats(_axioms(c)).withColumn("document", F.regexp_extract("file", "/([^/]+)/[^/]+$", 1))
    return found.groupBy("document").agg(*(F.sum(x).alias(x) for x in ("axioms", "kept", "skipped")))


def _kept(c: Commerce) -> DataFrame:
    return frontend.retain(_axioms(c))


def _written_and_read(c: Commerce) -> DataFrame:
    path = shared_path(c.spark, "kept")
    owl.write_functional(_kept(c), path)
    return owl.read_functional(c.spark, path).select("text")


def _declared(c: Commerce) -> DataFrame:
    """Kept axioms and the declarations."""
    axioms = _axioms(c)
    return frontend.retain(axioms).unionByName(axioms.where("kind = 'Declaration'"))


def _signature(c: Commerce) -> DataFrame:
    axioms = _declared(c)
    return frontend.signature(axioms, frontend.normal_forms(axioms.where("kind <> 'Declaration'")))


def stacked(tables: dict[str, DataFrame] | Iterable, of: Iterable[str]) -> DataFrame:
    """Rows of several relations: relation, a, b, c."""
    parts = []
    for k in of:
        cols = [F.col(x) for x in columns(k)]
        parts.append(tables[k].select(F.lit(k).alias("relation"), *(x.alias(n) for n, x in zip("abc", [*cols, F.lit(None).cast("long")], strict=False))))
    return setops.union_all(*parts)


def _encoded(c: Commerce) -> DataFrame:
    tables, _ = frontend.encode_axioms(_declared(c))
    return stacked(tables, ("s", *(f"t{k}" for k in range(1, 7))))


def _unexpected(c: Commerce) -> DataFrame:
    try:
        frontend.encode_axioms(_axioms(c))
    except ValueError as e:
        return c.spark.range(1).select(F.lit(str(e).split(":")[0]).alias("error"))
    return c.spark.range(0).select(F.lit("").alias("error"))


def _files(c: Commerce, names: Iterable[str], write: Callable, read: Callable) -> DataFrame:
    folder, back = shared_path(c.spark, "axioms"), {}
    for k in names:
        path = f"{folder}/{RELATIONS[k][0]}"
        write(c.tables[k], path)
        back[k] = read(c.spark, path, k)
    return stacked(back, back)


def _aliased(c: Commerce) -> DataFrame:
    """JSON files under the relation's name as an alias: a column is found by it."""
    path = shared_path(c.spark, "json")
    sinks.write_json(c.tables["t3"], path, single_file=True)
    return encoded.read_json(c.spark, path, "t3").select("t3.subConcept", "t3.rhsRole", "t3.rhsFiller")


def _loaded(fmt: str) -> Callable[[Commerce], DataFrame]:
    def run(c: Commerce) -> DataFrame:
        folder = shared_path(c.spark, "ontology")
        sinks.write_ontology(c.tables, folder, c.dictionary)
        return stacked(encoded.load_ontology(c.spark, folder, fmt), c.tables)

    return run


def _dictionary_file(c: Commerce) -> DataFrame:
    path = shared_path(c.spark, "dictionary")
    sinks.write_dictionary(c.dictionary, path)
    return encoded.read_dictionary(c.spark, path)


def _overwritten(c: Commerce) -> DataFrame:
    path = shared_path(c.spark, "out")
    sinks.write_text(c.tables["t1"], path)
    sinks.write_text(c.tables["s"], path)
    return encoded.read_text(c.spark, path, "s")


def _one_file(c: Commerce) -> DataFrame:
    path = shared_path(c.spark, "out")
    sinks.write_text(c.tables["s"], path, single_file=True)
    lines = c.spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.agg(F.count_distinct("file").alias("files"), F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


def _by_scheme(c: Commerce) -> DataFrame:
    """The same files under their whole URI and, where the file system is the default one, by their path alone."""
    path = shared_path(c.spark, "out")
    sinks.write_text(c.tables["t3"], path)
    home = c.spark._jvm.org.apache.hadoop.fs.FileSystem.get(c.spark._jsc.hadoopConfiguration()).getUri().toString().rstrip("/")
    bare = path.replace("file://", "", 1) if path.startswith("file://") and home in ("file:", "file://") else path
    return encoded.read_text(c.spark, path, "t3").join(encoded.read_text(c.spark, bare, "t3"), columns("t3"), "left_semi")


def _streamed(c: Commerce) -> DataFrame:
    """S after the axioms of existentials and conjunctions have come later than the others."""
    late = ("t2", "t3")
    inc = Incremental({k: encoded.empty(c.spark, k) if k in late else c.tables[k] for k in c.tables})
    for k in late:
        inc.add(stacked(c.tables, (k,)))
    return inc.closure.s


def _other_result(c: Commerce) -> tuple[DataFrame, DataFrame]:
    """A hierarchy that another program might give: codes of its own, without what is above Party, with each brand below Party."""
    shift = 1_000_000
    words = c.dictionary.select((F.col("code") + shift).alias("code"), "term")
    party = c.dictionary.where("term = 'Party'").select(F.col("code").alias("superConcept"))
    theirs = c.tables["t1"].join(party, "superConcept", "left_anti").select("subConcept", "superConcept")
    brands = c.dictionary.where("term like 'B:%'").select(F.col("code").alias("subConcept")).join(F.broadcast(party))  # party is one row
    theirs = theirs.unionByName(brands)
    return theirs.select(*((F.col(x) + shift).alias(x) for x in columns("s"))), words


def _named_diff(c: Commerce) -> DataFrame:
    """Against that result, from its files."""
    theirs, words = _other_result(c)
    path = shared_path(c.spark, "theirs")
    sinks.write_text(theirs, f"{path}/s")
    sinks.write_dictionary(words, f"{path}/dictionary")
    return compare.named_differences(c.tables["t1"], c.dictionary, encoded.read_text(c.spark, f"{path}/s", "s"), encoded.read_dictionary(c.spark, f"{path}/dictionary"))


def _deltas(c: Commerce) -> tuple[DataFrame, ...]:
    """(new s, all s, new r, all r) after the first steps."""
    from lattica.plans.queries import _first_r, _s_after, _second_r

    s, r = _s_after(c), _second_r(c)
    return setops.delta(s, c.tables["s"]), s, setops.delta(r, _first_r(c)), r


def _rule2_new(c: Commerce) -> DataFrame:
    ds, s, _, _ = _deltas(c)
    return rules.rule2(ds, s, c.tables["t2"]).distinct()


def _rule4_new(c: Commerce) -> DataFrame:
    ds, s, dr, r = _deltas(c)
    return rules.rule4_delta(ds, s, dr, r, c.tables["t4"]).distinct()


def _rule6_new(c: Commerce) -> DataFrame:
    _, _, dr, r = _deltas(c)
    return rules.rule6_delta(dr, r, c.tables["t6"]).distinct()


def queries() -> dict[str, Callable[[Commerce], DataFrame]]:
    from lattica.plans.queries import _second_r

    two, three = ("s", "t1", "t5"), ("t2", "t3", "t4", "t6")
    text = (lambda df, path: sinks.write_text(df, path), encoded.read_text)
    return {
        "owl_read": lambda c: _shapes(_axioms(c)),
        "owl_read_lines": lambda c: _shapes(_axioms(c, True)),
        "owl_read_whole": lambda c: _shapes(_axioms(c, False)),
        "owl_retain": lambda c: _kept(c).select("text"),
        "owl_retain_stats": _stats,
        "owl_write": _written_and_read,
        **{f"normal_form{k}": (lambda k: lambda c: frontend.normal_forms(_kept(c))[f"t{k}"])(k) for k in range(1, 7)},
        "owl_signature": _signature,
        "owl_encode": _encoded,
        "owl_unexpected": _unexpected,
        "scan_text_pairs": lambda c: _files(c, two, *text),
        "scan_text_triples": lambda c: _files(c, three, *text),
        "scan_json": lambda c: _files(c, (*two, *three), sinks.write_json, encoded.read_json),
        "scan_json_alias": _aliased,
        "scan_parquet": lambda c: _files(c, (*two, *three), sinks.write_parquet, encoded.read_parquet),
        "load_text_ontology": _loaded("txt"),
        "load_json_ontology": _loaded("json"),
        "dictionary_file": _dictionary_file,
        "overwrite_output": _overwritten,
        "single_file_output": _one_file,
        "paths_by_scheme": _by_scheme,
        "rows_in_memory": lambda c: encoded.from_rows(c.spark, "t3", [(2, 10, 3), (3, 10, 4), (4, 11, 2)]),
        "semi_filter_second_roles": lambda c: setops.semi_filter(_second_r(c), "role", c.tables["t6"], "lhsRole2"),
        "semi_filter_type4_roles": lambda c: setops.semi_filter(_second_r(c), "role", c.tables["t4"], "lhsRole"),
        "rule4_filler_then_pair": lambda c: rules.rule4(c.tables["s"], _second_r(c), c.tables["t4"], "filler_then_pair").distinct(),
        "rule2_new": _rule2_new,
        "rule4_new": _rule4_new,
        "rule6_new": _rule6_new,
        "closure_without_type4": lambda c: closure.classify({**c.tables, "t4": encoded.empty(c.spark, "t4")}).s,
        "closure_deep": lambda c: decode(closure.Doubling(c.tables["t1"]).follow(c.tables["s"]), c.dictionary, columns("s")),
        "closure_streamed": _streamed,
        "named_diff": _named_diff,
    }


#: Axioms as the documents have them, read: lhs and rhs as the reader's columns, ok for those of the profile.
_AXIOMS = """,
q AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
ax AS (
  SELECT 'large' AS document, 'SubClassOf' AS kind, 'class' AS lk, NULL AS lr, ['<' || a || '>'] AS la, 'class' AS rk, NULL AS rr, ['<' || b || '>'] AS ra, 'SubClassOf(<' || a || '> <' || b || '>)' AS text, true AS ok FROM n1
  UNION ALL SELECT 'large', 'SubClassOf', 'class', NULL, ['<' || a || '>'], 'some', '<' || r || '>', ['<' || b || '>'], 'SubClassOf(<' || a || '> ObjectSomeValuesFrom(<' || r || '> <' || b || '>))', true FROM n3
  UNION ALL SELECT 'rest', 'SubClassOf', 'and', NULL, ['<' || a || '>', '<' || b || '>'], 'class', NULL, ['<' || c || '>'], 'SubClassOf(ObjectIntersectionOf(<' || a || '> <' || b || '>) <' || c || '>)', true FROM n2
  UNION ALL SELECT 'rest', 'SubClassOf', 'some', '<' || r || '>', ['<' || a || '>'], 'class', NULL, ['<' || b || '>'], 'SubClassOf(ObjectSomeValuesFrom(<' || r || '> <' || a || '>) <' || b || '>)', true FROM n4
  UNION ALL SELECT 'rest', 'SubObjectPropertyOf', 'role', '<basedIn>', [], 'role', '<locatedIn>', [], 'SubObjectPropertyOf(<basedIn> <locatedIn>)', true
  UNION ALL SELECT 'rest', 'SubPropertyChainOf', 'chain', NULL, ['<locatedIn>', '<partOf>'], 'role', '<locatedIn>', [], 'SubObjectPropertyOf(ObjectPropertyChain(<locatedIn> <partOf>) <locatedIn>)', true
  UNION ALL SELECT 'rest', 'SubClassOf', 'and', NULL, ['<N:' || n_name || '>', '<R:' || r_name || '>', '<Zone>'], 'class', NULL, ['<Market:' || n_name || '>'], 'SubClassOf(ObjectIntersectionOf(<N:' || n_name || '> <R:' || r_name || '> <Zone>) <Market:' || n_name || '>)', true FROM q
  UNION ALL SELECT 'rest', 'SubPropertyChainOf', 'chain', NULL, ['<basedIn>', '<partOf>', '<within>'], 'role', '<reach>', [], 'SubObjectPropertyOf(ObjectPropertyChain(<basedIn> <partOf> <within>) <reach>)', true
  UNION ALL SELECT 'rest', 'ObjectPropertyDomain', 'some', '<basedIn>', ['owl:Thing'], 'class', NULL, ['<Party>'], 'ObjectPropertyDomain(<basedIn> <Party>)', true
  UNION ALL SELECT 'rest', 'SubClassOf', 'class', NULL, ['<S:' || s_suppkey || '>'], 'value', '<ratedBy>', ['<i:' || s_nationkey || '>'], 'SubClassOf(<S:' || s_suppkey || '> ObjectHasValue(<ratedBy> <i:' || s_nationkey || '>))', true FROM supplier
  UNION ALL SELECT 'rest', 'SubClassOf', 'oneof', NULL, ['<i:' || n_nationkey || '>'], 'class', NULL, ['<Agency>'], 'SubClassOf(ObjectOneOf(<i:' || n_nationkey || '>) <Agency>)', true FROM nation
  UNION ALL SELECT 'rest', 'EquivalentClasses', 'other', NULL, [], 'other', NULL, [], 'EquivalentClasses(<N:' || n_name || '> <Z:' || n_name || '>)', false FROM nation
  UNION ALL SELECT 'rest', 'SubClassOf', 'class', NULL, ['<S:' || s_suppkey || '>'], 'and', NULL, ['<Party>', '<Vendor>'], 'SubClassOf(<S:' || s_suppkey || '> ObjectIntersectionOf(<Party> <Vendor>))', false FROM supplier
  UNION ALL SELECT 'rest', 'SubClassOf', 'oneof', NULL, ['<i:' || r_regionkey || '>', '<i:none>'], 'class', NULL, ['<Agency>'], 'SubClassOf(ObjectOneOf(<i:' || r_regionkey || '> <i:none>) <Agency>)', false FROM region
  UNION ALL SELECT 'rest', 'Declaration', 'class', NULL, ['<Lonely:' || r_name || '>'], 'other', NULL, [], 'Declaration(Class(<Lonely:' || r_name || '>))', false FROM region),
k AS (SELECT DISTINCT * FROM ax WHERE ok),
f1 AS (SELECT DISTINCT la[1] AS a, ra[1] AS b FROM k WHERE kind = 'SubClassOf' AND lk IN ('class', 'oneof') AND rk = 'class'),
f2 AS (
  SELECT la[1] AS a, la[2] AS b, ra[1] AS c FROM k WHERE lk = 'and' AND len(la) = 2
  UNION SELECT la[1], la[2], 'And(' || la[1] || ' ' || la[2] || ')' FROM k WHERE lk = 'and' AND len(la) = 3
  UNION SELECT 'And(' || la[1] || ' ' || la[2] || ')', la[3], ra[1] FROM k WHERE lk = 'and' AND len(la) = 3),
f3 AS (SELECT DISTINCT la[1] AS a, rr AS r, ra[1] AS b FROM k WHERE rk IN ('some', 'value')),
f4 AS (SELECT DISTINCT lr AS r, la[1] AS a, ra[1] AS b FROM k WHERE lk = 'some'),
f5 AS (SELECT DISTINCT lr AS a, rr AS b FROM k WHERE kind = 'SubObjectPropertyOf'),
f6 AS (
  SELECT la[1] AS a, la[2] AS b, rr AS c FROM k WHERE lk = 'chain' AND len(la) = 2
  UNION SELECT la[1], la[2], 'Chain(' || la[1] || ' ' || la[2] || ')' FROM k WHERE lk = 'chain' AND len(la) = 3
  UNION SELECT 'Chain(' || la[1] || ' ' || la[2] || ')', la[3], rr FROM k WHERE lk = 'chain' AND len(la) = 3),
ind AS (SELECT DISTINCT unnest(la) AS term FROM k WHERE lk = 'oneof' UNION SELECT DISTINCT unnest(ra) FROM k WHERE rk = 'value'),
con AS (
  SELECT a AS term FROM f1 UNION SELECT b FROM f1 UNION SELECT a FROM f2 UNION SELECT b FROM f2 UNION SELECT c FROM f2
  UNION SELECT a FROM f3 UNION SELECT b FROM f3 UNION SELECT a FROM f4 UNION SELECT b FROM f4
  UNION SELECT la[1] FROM ax WHERE kind = 'Declaration'),
rol AS (SELECT r AS term FROM f3 UNION SELECT r FROM f4 UNION SELECT a FROM f5 UNION SELECT b FROM f5 UNION SELECT a FROM f6 UNION SELECT b FROM f6 UNION SELECT c FROM f6),
sig AS (
  SELECT 0 AS kind, term FROM con WHERE term NOT IN (SELECT term FROM ind)
  UNION ALL SELECT 1, term FROM rol UNION ALL SELECT 2, term FROM ind),
od AS (
  SELECT CAST(1 + row_number() OVER (ORDER BY kind, term) AS BIGINT) AS code, term, kind FROM sig WHERE term <> 'owl:Thing'
  UNION ALL SELECT CAST(1 AS BIGINT), 'owl:Thing', 0)"""

#: First steps with what is new in them: nw for new.
_NEW = """,
ma AS (SELECT x, a, NOT EXISTS (SELECT 1 FROM s WHERE s.x = sa.x AND s.a = sa.a) AS nw FROM sa),
mb AS (SELECT r, x, y, NOT EXISTS (SELECT 1 FROM ra WHERE ra.r = rb.r AND ra.x = rb.x AND ra.y = rb.y) AS nw FROM rb)"""


def oracle_sql(with_: Callable[[str, str], str], steps: str, closed: str) -> dict[str, str]:
    s_cols, r_cols = "x AS \"subConcept\", a AS \"superConcept\"", "r AS role, x AS \"pairX\", y AS \"pairY\""
    t3_cols = "a AS \"subConcept\", r AS \"rhsRole\", b AS \"rhsFiller\""
    shapes = with_(_AXIOMS, "SELECT kind, lk AS lhs_kind, lr AS lhs_role, array_to_string(la, ',') AS lhs_args, rk AS rhs_kind, rr AS rhs_role, array_to_string(ra, ',') AS rhs_args, text FROM ax")
    kept = with_(_AXIOMS, "SELECT text FROM k")
    stack = {
        "s": "SELECT 's' AS relation, x AS a, a AS b, CAST(NULL AS BIGINT) AS c FROM s", "t1": "SELECT 't1', a, b, NULL FROM t1", "t2": "SELECT 't2', a, b, c FROM t2",
        "t3": "SELECT 't3' AS relation, a, r, b FROM t3", "t4": "SELECT 't4', r, a, b FROM t4", "t5": "SELECT 't5', a, b, NULL FROM t5", "t6": "SELECT 't6', a, b, c FROM t6",
    }
    stacked_ = lambda names: with_("", " UNION ALL ".join(stack[k] for k in names))
    every = stacked_(stack)
    code = lambda t, cols: f"SELECT '{t}', {', '.join(f'd{i}.code' for i in range(len(cols)))}{', NULL' * (3 - len(cols))} FROM f{t[1]} f " + " ".join(f"JOIN od d{i} ON f.{x} = d{i}.term" for i, x in enumerate(cols))
    by_code = "SELECT 's' AS relation, code AS a, code AS b, CAST(NULL AS BIGINT) AS c FROM od WHERE kind = 0 AND code <> 1 UNION ALL SELECT 's', code, 1, NULL FROM od WHERE kind = 0 AND code <> 1"
    by_code += "".join(" UNION ALL " + code(t, cols) for t, cols in {"t1": "ab", "t2": "abc", "t3": "arb", "t4": "rab", "t5": "ab", "t6": "abc"}.items())
    chain = ", chain(x, a) AS (SELECT x, a FROM s UNION SELECT chain.x, t1.b FROM chain JOIN t1 ON chain.a = t1.a)"
    theirs = ", th AS (SELECT a, b FROM n1 WHERE b <> 'Party' UNION SELECT term, 'Party' FROM terms WHERE term LIKE 'B:%')"
    forms = {1: ("t1", "ab"), 2: ("t2", "abc"), 3: ("t3", "arb"), 4: ("t4", "rab"), 5: ("t5", "ab"), 6: ("t6", "abc")}
    named = lambda t, cols: ", ".join(f"{x} AS \"{n}\"" for x, n in zip(cols, columns(t), strict=True))
    return {
        "owl_read": shapes,
        "owl_read_lines": shapes,
        "owl_read_whole": shapes,
        "owl_retain": kept,
        "owl_retain_stats": with_(_AXIOMS, "SELECT document, count(*) AS axioms, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS skipped FROM ax GROUP BY document"),
        "owl_write": kept,
        **{f"normal_form{k}": with_(_AXIOMS, f"SELECT {named(t, cols)} FROM f{k}") for k, (t, cols) in forms.items()},
        "owl_signature": with_(_AXIOMS, "SELECT kind, term FROM sig"),
        "owl_encode": with_(_AXIOMS, by_code),
        "owl_unexpected": "SELECT 'unexpected axiom' AS error",
        "scan_text_pairs": stacked_(("s", "t1", "t5")),
        "scan_text_triples": with_("", stack["t3"].replace("a, r, b", "a, r AS b, b AS c") + " UNION ALL " + " UNION ALL ".join(stack[k] for k in ("t2", "t4", "t6"))),
        "scan_json": every,
        "scan_json_alias": with_("", f"SELECT {t3_cols} FROM t3"),
        "scan_parquet": every,
        "load_text_ontology": every,
        "load_json_ontology": every,
        "dictionary_file": with_("", "SELECT code, term FROM dict"),
        "overwrite_output": with_("", f"SELECT {s_cols} FROM s"),
        "single_file_output": with_("", "SELECT CAST(1 AS BIGINT) AS files, count(*) AS lines, CAST(sum(length(x || '|' || a)) AS BIGINT) AS chars FROM s"),
        "paths_by_scheme": with_("", f"SELECT {t3_cols} FROM t3"),
        "rows_in_memory": "SELECT CAST(x AS BIGINT) AS \"subConcept\", CAST(y AS BIGINT) AS \"rhsRole\", CAST(z AS BIGINT) AS \"rhsFiller\" FROM (VALUES (2, 10, 3), (3, 10, 4), (4, 11, 2)) v(x, y, z)",
        "semi_filter_second_roles": with_(steps, f"SELECT {r_cols} FROM rb WHERE EXISTS (SELECT 1 FROM t6 WHERE t6.b = rb.r)"),
        "semi_filter_type4_roles": with_(steps, f"SELECT {r_cols} FROM rb WHERE EXISTS (SELECT 1 FROM t4 WHERE t4.r = rb.r)"),
        "rule4_filler_then_pair": with_(steps, f"SELECT {s_cols} FROM s4"),
        "rule2_new": with_(steps + _NEW, "SELECT DISTINCT p.x AS \"subConcept\", t2.c AS \"superConcept\" FROM ma p JOIN t2 ON p.a = t2.a JOIN ma q ON q.x = p.x AND q.a = t2.b WHERE p.nw OR q.nw"),
        "rule4_new": with_(steps + _NEW, "SELECT DISTINCT p.x AS \"subConcept\", t4.b AS \"superConcept\" FROM mb p JOIN t4 ON p.r = t4.r JOIN ma q ON q.x = p.y AND q.a = t4.a WHERE p.nw OR q.nw"),
        "rule6_new": with_(steps + _NEW, "SELECT DISTINCT t6.c AS role, p.x AS \"pairX\", q.y AS \"pairY\" FROM mb p JOIN t6 ON p.r = t6.a JOIN mb q ON q.r = t6.b AND p.y = q.x WHERE p.nw OR q.nw"),
        "closure_without_type4": with_(chain, f"SELECT {s_cols} FROM chain"),
        "closure_deep": with_(chain, "SELECT p.term AS \"subConcept\", q.term AS \"superConcept\" FROM chain c JOIN dict p ON c.x = p.code JOIN dict q ON c.a = q.code"),
        "closure_streamed": closed,
        "named_diff": with_(theirs, "SELECT a AS \"subConcept\", b AS \"superConcept\", 'missing' AS side FROM (SELECT * FROM th EXCEPT SELECT a, b FROM n1) UNION ALL SELECT a, b, 'extra' FROM (SELECT a, b FROM n1 EXCEPT SELECT * FROM th)"),
    }
