"""OWL functional syntax, read and written.

An axiom is a row: file, kind, text (in one form of spacing), and for its two
sides lhs_kind, lhs_role, lhs_args, rhs_kind, rhs_role, rhs_args; lhs_count is
the number of lhs_args, nested says that an argument is itself an expression.
Side kinds: class, some, value, and, oneof, role, chain, other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXIOMS = "file string, kind string, lhs_kind string, lhs_role string, lhs_args array<string>, lhs_count int, rhs_kind string, rhs_role string, rhs_args array<string>, nested boolean, text string"
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+?(?=[\s)]))?|<[^>]*>|[()=]|#[^\n]*|[^\s()="<]+(?:<[^>]*>)?')
#: Expression names of the syntax and our side kinds.
_SIDES = {"ObjectSomeValuesFrom": "some", "ObjectHasValue": "value", "ObjectIntersectionOf": "and", "ObjectOneOf": "oneof", "ObjectPropertyChain": "chain"}
_WRAPPERS = {"Ontology", "Prefix", "Import", "Annotation"}


def tree(text: str) -> list:
    """Nested lists: [name, argument, ...] for each name(...), strings for the rest."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(text):
        if token.startswith("#"):
            continue
        if token == "(":
            name = stack[-1].pop() if stack[-1] and isinstance(stack[-1][-1], str) else ""
            stack.append([name])
        elif token == ")":
            if len(stack) == 1:
                raise ValueError(f"unbalanced ) in {text[:80]!r}")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    if len(stack) > 1:
        raise ValueError(f"missing ) in {text[:80]!r}")
    return stack[0]


def render(node: list | str) -> str:
    return node if isinstance(node, str) else f"{node[0]}({' '.join(render(x) for x in node[1:])})"


def _name(node: list | str) -> str:
    name = render(node)
    return "owl:Thing" if name == "<http://www.w3.org/2002/07/owl#Thing>" else name


def side(node: list | str) -> tuple[str, str | None, list[str], bool]:
    """(kind, role, arguments, nested) of one side of an axiom."""
    if isinstance(node, str):
        return "class", None, [_name(node)], False
    kind = _SIDES.get(node[0], "other")
    args = node[1:]
    if kind in ("some", "value") and len(args) == 2:
        role, args = render(args[0]), args[1:]
        return kind, role, [_name(a) for a in args], not isinstance(args[0], str) or role.endswith(")")
    if kind in ("and", "oneof", "chain") and args:
        return kind, None, [_name(a) for a in args], any(not isinstance(a, str) for a in args)
    return "other", None, [_name(a) for a in args], True


def axioms_of(text: str) -> Iterator[tuple]:
    """Rows without the file, for every axiom and class declaration in a text."""

    def walk(nodes: list) -> Iterator[tuple]:
        for node in nodes:
            if isinstance(node, str) or not node:
                continue
            if node[0] == "Ontology":
                yield from walk(node[1:])
            elif node[0] not in _WRAPPERS:
                yield row(node)

    def row(node: list) -> tuple:
        kind = node[0]
        args = [a for a in node[1:] if isinstance(a, str) or a[0] != "Annotation"]
        none = ("other", None, [], False)
        left = right = none
        if kind == "Declaration" and args and isinstance(args[0], list):
            left = ("class" if args[0][0] == "Class" else "other", None, [_name(a) for a in args[0][1:]], False)
        elif kind == "SubClassOf" and len(args) == 2:
            left, right = side(args[0]), side(args[1])
        elif kind == "SubObjectPropertyOf" and len(args) == 2:
            first = side(args[0])
            right = ("role", render(args[1]), [], not isinstance(args[1], str))
            if first[0] == "chain":
                kind, left = "SubPropertyChainOf", first
            else:
                left = ("role", render(args[0]), [], not isinstance(args[0], str))
        elif kind == "ObjectPropertyDomain" and len(args) == 2:
            left, right = ("some", render(args[0]), ["owl:Thing"], not isinstance(args[0], str)), side(args[1])
        return kind, left[0], left[1], left[2], len(left[2]), right[0], right[1], right[2], left[3] or right[3], render([node[0], *args])

    yield from walk(tree(text))


#: What of a line is no structure: texts in quotes, IRIs, comments.
_OPAQUE = r'"(?:[^"\\]|\\.)*"|<[^>]*>|#.*$'
#: Lines that open or close a document.
_FRAME = r"^\s*(Ontology\([^()]*|\))\s*$"


def one_axiom_a_line(text: DataFrame) -> bool:
    """Whether every line of the column `value` is whole in itself, but for those that open or close a document."""
    bare = F.regexp_replace("value", _OPAQUE, "")
    depth = F.length(F.translate(bare, ")", "")) - F.length(F.translate(bare, "(", ""))
    framed = F.regexp_replace("value", r'<[^>]*>', "").rlike(_FRAME)
    return text.where((depth != 0) & ~framed).isEmpty()


def read_functional(spark: SparkSession, path: str, by_line: bool | None = None) -> DataFrame:
    """Axioms of a file or of all files of a folder.

    Files in which each axiom stands on one line, as programs write them, are split
    over tasks; of others a task parses a whole file. by_line None finds out which, at
    the price of a scan.
    """
    if by_line is None:
        by_line = one_axiom_a_line(spark.read.text(path))
    text = spark.read.text(path, wholetext=not by_line).select(F.col("_metadata.file_path").alias("file"), "value")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in AXIOMS.split(", ")]
        kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
        for batch in batches:
            rows = []
            for file, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if by_line and (not re.match(r"\s*\w+\(", value) or re.match(r"\s*(Ontology|Prefix|Import)\(", value)):
                    continue
                rows += [(file, *r) for r in axioms_of(value)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return text.mapInArrow(parse, AXIOMS)


def write_functional(axioms: DataFrame, path: str, iri: str = "urn:ontology", single_file: bool = True) -> None:
    """Every axiom on a line of its own: one document, or with single_file=False a file of axioms from each task."""
    line = axioms.select(F.lit(1).alias("o"), F.col("text").alias("value"))
    if not single_file:
        line.select("value").write.mode("overwrite").text(path)
        return
    spark = axioms.sparkSession
    frame = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(f"Ontology(<{iri}>").alias("value")), F.struct(F.lit(2).alias("o"), F.lit(")").alias("value")))).alias("x")).select("x.*")
    line.unionByName(frame).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)
