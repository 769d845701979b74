"""Every query with an SQL equivalent gives its rows, names and types; and those without one run."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as driver
from orrery.plans.catalogue import ORACLES, QUERIES
from orrery.sources.tables import NAMES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    kinds = dict(df.dtypes)
    for column, *kind in cursor.description:
        for ours, theirs in (("bigint", "BIGINT"), ("double", "DOUBLE")):
            assert (kinds[column] == ours) == (str(kind[0]) == theirs), column
    want = ordered([tuple(plain(v) for v in r) for r in cursor.fetchall()])
    assert ordered([tuple(plain(r[c]) for c in names) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_full_outer_covers_both_tables(spark, sf_dir):
    rows = QUERIES["full_outer"](spark, sf_dir).collect()
    for table, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        want = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())
        assert sorted(r[key] for r in rows if r[key] is not None) == want
        assert any(r[key] is None for r in rows)
