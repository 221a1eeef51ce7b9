"""Bowling style inferred from a bowler's statistical fingerprint."""

from pyspark.sql import DataFrame

from creaseline.functions import double, per_over, safe_div
from creaseline.operators.rollups import bowler_phase_rollup, summed
from creaseline.params import Params

# Thresholds of the spin rule.
SPIN_MIN_MIDDLE_DOT_SHARE = 0.28
SPIN_MAX_OPENING_SHARE = 0.22
SPIN_MAX_MIDDLE_ECONOMY = 7.8

_SPIN = (
    f"({safe_div('mid_dots', 'mid_balls')}) > {double(SPIN_MIN_MIDDLE_DOT_SHARE)}"
    f" AND ({safe_div('pp_balls', 'total_balls')}) < {double(SPIN_MAX_OPENING_SHARE)}"
    f" AND ({per_over('mid_runs', 'mid_balls')}) < {double(SPIN_MAX_MIDDLE_ECONOMY)}"
)


def bowler_styles_from(rollup: DataFrame, params: Params = Params()) -> DataFrame:
    """Fingerprint and style per bowler, from the (bowler, phase) rollup (legal balls only)."""
    prints = summed(rollup.filter("bowler IS NOT NULL"), ["bowler"], [
        "sum(balls_bowled) AS total_balls",
        "sum(opening_balls) AS pp_balls",
        "sum(IF(phase = 'middle', balls_bowled, 0)) AS mid_balls",
        "sum(IF(phase = 'middle', dot_balls, 0)) AS mid_dots",
        "sum(legal_runs) AS total_runs",
        "sum(IF(phase = 'middle', legal_runs, 0D)) AS mid_runs",
    ])
    style = (
        f"CASE WHEN total_balls < {params.bowler_balls} THEN 'unknown'"
        f" WHEN {_SPIN} THEN 'spin' ELSE 'pace' END AS bowling_style"
    )
    return prints.filter("total_balls > 0").selectExpr("*", style)


def bowler_styles(fact: DataFrame, params: Params = Params()) -> DataFrame:
    return bowler_styles_from(bowler_phase_rollup(fact), params)


def attach_styles(fact: DataFrame, styles: DataFrame) -> DataFrame:
    """Add `bowling_style` to each delivery.

    Spark broadcasts the styles only when they fit its size threshold; past it, adaptive execution
    splits the partitions of a bowler who holds a large share of the deliveries.
    """
    joined = fact.join(
        styles.selectExpr("bowler", "bowling_style AS known_style"), "bowler", "left"
    )
    return joined.selectExpr(
        *[f"`{name}`" for name in fact.columns],
        "coalesce(known_style, 'unknown') AS bowling_style",
    )
