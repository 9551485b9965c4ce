"""Every registered query against its SQL on the smallest tables, and sane rows where there is none."""

import os

import pytest

from evidenta.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Fitted models and whole claim runs take long; test_models and test_reports_and_claims cover them on small tables.
SLOW = {"driver_regression", "driver_classification", "driver_importance", "segments", "adjusted_association", "claims_proved", "claims_tested"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in found.fetchall()]
    key = lambda r: tuple((v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r)
    rows, expected = sorted(rows, key=key), sorted(expected, key=key)
    assert len(rows) == len(expected)
    assert all(same(x, y) for a, b in zip(rows, expected, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
