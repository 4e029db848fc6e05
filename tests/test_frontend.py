"""Files, dictionary, OWL front end, command line and stream."""

import pytest

from lattica.cli import main
from lattica.functions import text
from lattica.operators.dictionary import build_dictionary, decode, encode, misses, seed
from lattica.plans.closure import classify
from lattica.plans.frontend import encode_axioms, retain, retain_stats
from lattica.schemas import columns
from lattica.sources import sinks
from lattica.sources.encoded import from_rows, load_ontology, read_dictionary, read_json, read_text
from lattica.sources.owl import axioms_of, read_functional, tree, write_functional
from lattica.streaming.incremental import Incremental
from tests.test_rules import MICRO, R_ALL, S_NEW, rows, tables

ONTOLOGY = """Prefix(:=<http://x/>)
Ontology(<http://x/o>
Declaration(Class(:Alone))
SubClassOf(:A :B) # comment
SubClassOf(Annotation(rdfs:comment "a ) in a \\"text\\"") :A ObjectSomeValuesFrom(:r :C))
SubClassOf(:A ObjectHasValue(:r :i))
SubClassOf(ObjectSomeValuesFrom(:r :C) :D)
SubClassOf(ObjectIntersectionOf(:B :D :A) :E)
SubClassOf(ObjectOneOf(:i) :F)
SubClassOf(ObjectOneOf(:i :j) :F)
SubObjectPropertyOf(:r :s)
SubObjectPropertyOf(ObjectPropertyChain(:r :s :r) :q)
ObjectPropertyDomain(:r :G)
EquivalentClasses(:A :Z)
SubClassOf(:A ObjectIntersectionOf(:B :C))
)
"""


def test_parser():
    assert tree("A(b C(<d e> \"f g\"))") == [["A", "b", ["C", "<d e>", '"f g"']]]
    for bad in ("A(b", "A b)"):
        with pytest.raises(ValueError):
            tree(bad)
    kinds = [r[0] for r in axioms_of(ONTOLOGY)]
    assert kinds.count("SubClassOf") == 8 and "SubPropertyChainOf" in kinds and "Declaration" in kinds


def test_profile_encode_classify(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.ofn").write_text(ONTOLOGY)
    (source / "b.ofn").write_text("Ontology(<http://x/p>\nSubClassOf(:A :B)\nSubClassOf(:B :H)\n)")
    axioms = read_functional(spark, str(source))
    stats = {r.file.rsplit("/", 1)[1]: (r.axioms, r.kept) for r in retain_stats(axioms).collect()}
    assert stats == {"a.ofn": (13, 9), "b.ofn": (2, 2)}
    write_functional(retain(axioms), str(tmp_path / "kept"))
    kept = read_functional(spark, str(tmp_path / "kept"), by_line=True)
    assert sorted(r.text for r in kept.collect()) == sorted(r.text for r in retain(axioms).collect())
    coded, dictionary = encode_axioms(kept)
    codes = {r.term: r.code for r in dictionary.collect()}
    assert codes["owl:Thing"] == 1 and len(set(codes.values())) == len(codes)
    named = {tuple(r) for r in decode(classify(coded).s, dictionary, columns("s")).collect()}
    # A has :r, so its domain G; A, B, D give E through a new term for the first two
    assert {(":A", ":B"), (":A", ":H"), (":A", ":D"), (":A", ":E"), (":A", ":G")} <= named
    assert not any(x == ":i" for x, _ in named)
    with_i, d = encode_axioms(kept, seed_individuals=True)
    assert (":i", ":F") in {tuple(r) for r in decode(classify(with_i).s, d, columns("s")).collect()}
    with pytest.raises(Exception, match="unexpected axiom"):
        encode_axioms(axioms)[0]["t1"].collect()


def test_files(spark, tmp_path):
    t = tables(spark, **MICRO)
    d = build_dictionary(spark.createDataFrame([(0, "a|b"), (0, "x"), (1, "r")], "kind int, term string"))
    sinks.write_ontology(t, str(tmp_path), d)
    for fmt in ("txt", "json"):
        back = load_ontology(spark, str(tmp_path), fmt)
        assert all(sorted(rows(back[k])) == sorted(MICRO[k]) for k in MICRO)
    assert {tuple(r) for r in read_dictionary(spark, str(tmp_path / "dictionary.txt")).collect()} == {(1, "owl:Thing"), (2, "a|b"), (3, "x"), (4, "r")}
    (tmp_path / "bad.txt").write_text("1|2\n1|2|3\n")
    with pytest.raises(Exception):
        read_text(spark, str(tmp_path / "bad.txt"), "s").collect()
    (tmp_path / "bad.json").write_text('{"subConcept": "x"}\n')
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path / "bad.json"), "s").collect()


def test_lines(spark):
    t3 = from_rows(spark, "t3", MICRO["t3"])
    assert sorted(rows(text.parse_lines(text.format_lines(t3, "t3"), "t3"))) == MICRO["t3"]
    assert sorted(rows(text.from_json_lines(text.to_json_lines(t3, "t3"), "t3"))) == MICRO["t3"]
    for bad in ("1|2", "1|x|3", ""):
        with pytest.raises(Exception):
            text.parse_lines(spark.createDataFrame([(bad,)], "value string"), "t3").collect()


def test_dictionary(spark):
    terms = spark.createDataFrame([(k, f"t{i}") for i in range(200) for k in (0,)] + [(1, "role"), (0, "t0")], "kind int, term string")
    d = build_dictionary(terms)
    codes = {r.term: r.code for r in d.collect()}
    order = sorted(f"t{i}" for i in range(200)) + ["role"]
    assert codes == {"owl:Thing": 1, **{t: i + 2 for i, t in enumerate(order)}}
    df = spark.createDataFrame([("t1", "t2"), ("t3", "zz")], "a string, b string")
    assert [r.term for r in misses(df, d, "b").collect()] == ["zz"]
    assert encode(df, d, ["a", "b"], strict=False).count() == 1
    with pytest.raises(Exception, match="no code for term"):
        encode(df, d, ["a", "b"]).collect()
    with pytest.raises(Exception, match="no term for code"):
        decode(from_rows(spark, "s", [(1, 99999)]), d, columns("s")).collect()
    assert sorted(rows(seed(spark.createDataFrame([(1,), (5,)], "code long")))) == [(1, 1), (5, 1), (5, 5)]


def test_command_line(spark, tmp_path):
    (tmp_path / "o.ofn").write_text("Ontology(<http://x/p>\nSubClassOf(:A :B)\nSubClassOf(:B :C)\n)")
    assert main(["profile", str(tmp_path / "o.ofn"), str(tmp_path / "kept")]) == 0
    assert main(["encode", str(tmp_path / "kept"), str(tmp_path / "coded")]) == 0
    assert main(["classify", str(tmp_path / "coded"), str(tmp_path / "out"), "--single-file"]) == 0
    s = {tuple(r) for r in read_text(spark, str(tmp_path / "out/sAxioms"), "s").collect()}
    assert len(s) == 9 and (2, 4) in s
    assert main(["diff", str(tmp_path / "out/sAxioms"), str(tmp_path / "out/sAxioms")]) == 0
    assert main(["diff", str(tmp_path / "out/sAxioms"), str(tmp_path / "coded/sAxioms.txt")]) == 1


def test_stream(spark, tmp_path):
    first = {k: v for k, v in MICRO.items() if k != "t4"}
    inc = Incremental(tables(spark, **first))
    spark.createDataFrame([("t4", *MICRO["t4"][0])], "relation string, a long, b long, c long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("relation string, a long, b long, c long").parquet(str(tmp_path / "in"))
    q = inc.start(stream, str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    assert set(rows(inc.closure.s)) == set(MICRO["s"]) | S_NEW and set(rows(inc.closure.r)) == R_ALL
