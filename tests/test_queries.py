"""Every registered query of the library against its SQL, in DuckDB, over the smallest tables."""

import decimal

import duckdb
import pytest

from runledger.plans import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat()[:26].replace("+00:00", "") if hasattr(v, "isoformat") else v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*(table[c].to_pylist() for c in names), strict=True)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toArrow()
    assert len(set(got.column_names)) == len(got.column_names)
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(registry.ORACLE_SQL[name]).to_arrow_table())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
