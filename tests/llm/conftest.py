"""Awkward rows that every operator has to take, and helpers."""

import pytest

SF = "/root/testdata/sf0.001"
WORDS = "the and tion her for was not with that from shall public moon river stone light cloud garden winter summer paper".split()


def sentence(k: int, n: int) -> str:
    return " ".join(WORDS[(k * 7 + i * (k + 3) + i * i) % len(WORDS)] + str((k * i) % 13) for i in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, texts, langs and sources; empty, blank, one-word and very long texts; copies; repeated rows; clashing names."""
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, "a b c"), (6, long), (7, sentence(3, 60)), (8, sentence(3, 60)), (9, sentence(3, 59) + " changed"),
        (9, sentence(4, 40)), (10, "x\n" * 40 + "tail"), (10, "x\n" * 40 + "tail"), (None, sentence(5, 30)), (None, None), (20, "MIT License, ÉTÉ ß İ 1"), (21, "\x1c\x85 <|endoftext|>'s don't"), (22, "A" * 5000),
    ]
    rows = [(i, t, ("en", "fr", None)[k % 3], ("s1", "s1", None, "s2")[k % 4], len(t or ""), "key", 1, 2.0) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, id int, score double")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
