"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
from conftest import SMALL
from creaseline.catalogue import queries
from creaseline.sources import testdata

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("nation", "customer", "supplier", "orders", "lineitem"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([str(row[i]) for i in order] for row in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SMALL)
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    mine = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = canonical(relation.columns, relation.fetchall())
    assert mine == theirs
    assert mine


def test_only_the_archetypes_have_no_sql():
    assert set(queries.QUERIES) - set(registry.ORACLES) == {"bowling_archetypes"}


def test_entry_runs(spark):
    assert not registry.entry(spark).isEmpty()


def test_presentation_order(spark):
    rows = queries.matchups_presented(spark, SMALL).collect()
    assert all(b['presented'] == 1 or a['presented'] + 1 == b['presented'] for a, b in zip(rows, rows[1:]))
    assert rows == sorted(rows, key=lambda r: (r["batter"], -r["balls_faced"], r["bowler"]))


def test_adapter_skips_only_joins_that_change_nothing(spark):
    columns = ["match_id", "venue", "innings", "ball", "runs_off_bat", "wides", "wicket_type"]
    full = testdata.deliveries(spark, SMALL).groupBy(*columns).count()
    for keys in ((), ("bowler",), ("season",)):
        lean = testdata.deliveries(spark, SMALL, keys).groupBy(*columns).count()
        assert full.exceptAll(lean).isEmpty() and lean.exceptAll(full).isEmpty()


def test_scan_reads_only_needed_columns(spark):
    plan = queries.innings_totals(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan and "l_shipdate" not in plan and "orders" not in plan
