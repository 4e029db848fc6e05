"""Queries over documents and files against their SQL; deep chains; a closure that grows; owned tables."""

import os

import pytest

from lattica.operators.compare import same
from lattica.plans import ontology_queries
from lattica.plans.closure import Parts, classify, subclass_closure
from lattica.plans.queries import oracle_sql, queries
from lattica.sources.encoded import from_rows
from lattica.sources.owl import one_axiom_a_line, read_functional, write_functional
from lattica.sources.sinks import show
from lattica.storage import estimated_bytes, shared_path, temporary, written
from lattica.streaming.incremental import Incremental
from tests.test_queries import SF, duck  # noqa: F401
from tests.test_rules import MICRO, rows, tables


@pytest.mark.parametrize("name", list(ontology_queries.queries()))
def test_same_rows(spark, duck, name):  # noqa: F811
    ours, theirs = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    plain = lambda r: tuple(None if x != x else x for x in r)
    got = [plain(r) for r in ours.select(*cols).collect()]
    want = [plain(r) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({oracle_sql()[name]})").fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_deep_chain(spark):
    """A chain of 1500 concepts: all 1500 * 1501 / 2 facts, in few rounds."""
    n = 1500
    t = tables(spark, s=[(i, i) for i in range(2, 2 + n)], t1=[(i, i + 1) for i in range(2, 1 + n)])
    found = classify(t)
    assert found.complete and found.s.count() == n * (n + 1) // 2 and len(found.rounds) < 12
    with pytest.warns(RuntimeWarning, match="max_rounds=3"):
        cut = classify(t, max_rounds=3)
    assert not cut.complete


def test_cycles_end(spark):
    s = subclass_closure(from_rows(spark, "s", [(2, 2)]), from_rows(spark, "t1", [(k, 2 + (k - 1) % 25) for k in range(2, 27)]))
    assert s.count() == 25


def test_closure_goes_on(spark):
    """Added axioms of every relation give what a closure from the beginning gives, and nothing known is found again."""
    want = classify(tables(spark, **MICRO))
    for late in ("t2", "t4", "s"):
        inc = Incremental(tables(spark, **{k: v for k, v in MICRO.items() if k != late}))
        before = inc.closure.s.count() + inc.closure.r.count()
        rows_ = [(late, *r, *[None] * (3 - len(r))) for r in MICRO[late]]
        found = inc.add(spark.createDataFrame(rows_, "relation string, a long, b long, c long"))
        assert same(found.s, want.s) and same(found.r, want.r), late
        new = sum(s + r for _, s, r, _ in found.rounds)
        assert new <= want.s.count() + want.r.count() - before
    with pytest.raises(ValueError):
        inc.add(spark.createDataFrame([("t9", 1, 2, None)], "relation string, a long, b long, c long"))


def test_parts_become_one(spark):
    p = Parts(from_rows(spark, "s", [(0, 0)]), "p")
    for k in range(1, 30):
        p.add(from_rows(spark, "s", [(k, k)]))
        p.compact()
        assert rows(p.new) == [(k, k)]
    assert len(p.paths) < 14 and sorted(rows(p.all)) == [(k, k) for k in range(30)]


def test_axioms_over_lines(spark, tmp_path):
    whole, split = tmp_path / "a.ofn", tmp_path / "b.ofn"
    split.write_text("Ontology(<http://x/p>\nSubClassOf(:A\n  :B)\nSubClassOf(:B :C) # ( in a comment\n)")
    whole.write_text("Prefix(:=<http://x/>)\nOntology(<http://x/p(>\nSubClassOf(:A :B)\nSubClassOf(Annotation(:c \"a )) b\") :B :C) # )\n)")
    assert one_axiom_a_line(spark.read.text(str(whole))) and not one_axiom_a_line(spark.read.text(str(split)))
    for path in (whole, split):
        assert sorted(r.text for r in read_functional(spark, str(path)).collect()) == ["SubClassOf(:A :B)", "SubClassOf(:B :C)"]
    axioms = read_functional(spark, str(split))
    write_functional(axioms, str(tmp_path / "out"), single_file=False)
    assert sorted(r.text for r in read_functional(spark, str(tmp_path / "out")).collect()) == sorted(r.text for r in axioms.collect())


def test_owned_tables_go(spark):
    df = from_rows(spark, "s", [(1, 2)])
    with temporary(spark):
        path = shared_path(spark, "owned")
        assert rows(written(df, path)) == [(1, 2)]
        local = path.removeprefix("file://")
        assert os.path.isdir(local)
    assert not os.path.isdir(local) and estimated_bytes(df) > 0


def test_console(spark, capsys):
    show(from_rows(spark, "s", [(1, 2)]))
    assert "superConcept" in capsys.readouterr().out
