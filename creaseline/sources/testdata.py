"""Adapter: the TPC-H-like tables seen as deliveries and match information."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from creaseline.operators.features import enrich
from creaseline.schema import DELIVERY_COLUMNS

MATCH_ORDERS = 60  # order keys per match
VENUES = 25


# The columns read here. Stated, so that no job runs just to learn them.
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_discount double, l_tax double, l_returnflag string,"
    " l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "supplier": "s_suppkey bigint, s_name string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# Delivery columns from line items: two steps, so that each intermediate is computed once.
_MEASURED = [
    f"floor(l_orderkey / {MATCH_ORDERS}) AS match_no",
    f"l_orderkey % {MATCH_ORDERS} AS order_no",
    "CAST(l_quantity AS INT) % 10 AS stroke",
    "CAST(rint(l_discount * 100) AS INT) AS discount",
    "CAST(rint(l_tax * 100) AS INT) AS tax",
    "IF(l_suppkey % 2 = 0, l_partkey % 20, 4 + l_partkey % 16) AS over_no",
]
_EXTRAS = {
    "wides": "IF(discount = 10, 1D, 0D)",
    "noballs": "IF(discount = 0 AND tax = 8, 1D, 0D)",
    "byes": "IF(discount = 9 AND tax = 0, 1D, 0D)",
    "legbyes": "IF(discount = 8 AND tax = 1, 1D, 0D)",
}
_COLUMNS = {
    "match_id": "CAST(match_no AS STRING)",
    "venue": f"concat('NATION_', CAST(match_no % {VENUES} AS STRING))",
    "innings": f"IF(order_no = {MATCH_ORDERS - 1}, 3, 1 + CAST(order_no % 2 AS INT))",
    "ball": "concat(CAST(over_no AS STRING), '.', CAST(l_linenumber AS STRING))",
    "runs_off_bat": "CASE WHEN stroke < 5 THEN 0D WHEN stroke < 8 THEN 1D WHEN stroke = 8 THEN 4D"
    " ELSE 6D END",
    "extras": " + ".join(_EXTRAS.values()),
    **_EXTRAS,
    "penalty": "0D",
    "wicket_type": "CASE WHEN dayofyear(l_shipdate) % 20 != 0 THEN ''"
    " WHEN l_returnflag = 'R' THEN 'caught' WHEN l_returnflag = 'A' THEN 'bowled'"
    " WHEN l_linestatus = 'O' THEN 'run out' ELSE 'lbw' END",
    **dict.fromkeys(["player_dismissed", "other_wicket_type", "other_player_dismissed"], "''"),
}


def deliveries(
    spark: SparkSession, sf_dir: str, keys: Iterable[str] = ("striker", "bowler", "season")
) -> DataFrame:
    """One delivery per line item, in the typed delivery layout.

    `keys` names the looked-up columns the caller reads. The striker and the season need orders and
    customers, the bowler needs suppliers; tables nobody asked for are not joined, since every line
    item has exactly one of each, and their columns are NULL.
    """
    keys = set(keys)
    items = _table(spark, sf_dir, "lineitem")
    if {"striker", "season"} & keys:
        # Orders meet customers first, so that line items are shuffled once, on the order key.
        orders = _table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey AS l_orderkey", "o_custkey AS c_custkey",
            "CAST(year(o_orderdate) AS STRING) AS season",
        )
        if "striker" in keys:
            customers = _table(spark, sf_dir, "customer").join(
                _table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name"),
                "c_nationkey",
            ).selectExpr("c_custkey", "concat(n_name, '/', c_mktsegment) AS striker")
            orders = orders.join(customers, "c_custkey")
        items = items.join(orders.drop("c_custkey"), "l_orderkey")
    if "bowler" in keys:
        suppliers = _table(spark, sf_dir, "supplier").selectExpr(
            "s_suppkey AS l_suppkey", "s_name AS bowler"
        )
        items = items.join(suppliers, "l_suppkey")
    found = [name for name in ("striker", "bowler", "season") if name in items.columns]

    def column(name):
        if name in found:
            return name
        return f"{_COLUMNS.get(name, 'CAST(NULL AS STRING)')} AS {name}"

    return items.selectExpr(
        *found, "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus", *_MEASURED
    ).selectExpr(*[column(name) for name in DELIVERY_COLUMNS])


def fact(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Enriched deliveries; `keys` among striker, bowler and season are the ones to join in."""
    return enrich(deliveries(spark, sf_dir, keys))


def match_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match-information row per match found in orders."""
    venue = f"concat('NATION_', CAST(match_no % {VENUES} AS STRING))"
    return (
        _table(spark, sf_dir, "orders")
        .selectExpr(f"floor(o_orderkey / {MATCH_ORDERS}) AS match_no")
        .distinct()
        .selectExpr(
            "CAST(match_no AS STRING) AS match_id",
            f"{venue} AS venue",
            "IF(match_no % 3 = 0, 'bat', 'field') AS toss_decision",
            f"IF(match_no % 7 = 0, '', {venue}) AS winner",
        )
    )
