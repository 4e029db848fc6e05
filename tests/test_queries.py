"""Every query of the library against its SQL, by an engine of its own."""

import duckdb
import pytest

from lattica.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def test_all_have_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", ["encode_dictionary", "rule2_step", "rule4_delta", "rule6_delta", "closure_s", "closure_r", "closure_stats", "equivalents", "direct_supers", "superset_view", "profile_filter", "diff_missing"])
def test_same_rows(spark, duck, name):
    ours, theirs = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    got = [tuple(r) for r in ours.select(*cols).collect()]
    want = theirs.df()[cols].astype(object).values.tolist()
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2162
    assert set(e.oracle_sql()) <= set(e.queries())
