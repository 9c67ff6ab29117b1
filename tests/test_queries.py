"""Every query of the catalogue against its SQL in another engine."""

import duckdb
import pytest

from rillwork.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(x):
    return None if x is None else float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, other, name):
    want = other.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a = sorted(repr([tidy(r[c]) for c in columns]) for r in got.collect())
    b = sorted(repr([tidy(r[i]) for i in at]) for r in want.fetchall())
    assert len(a) > 0 and a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["row", "col", "value"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(catalog.oracle_sql()) <= set(__spark_entry__.oracle_sql())
