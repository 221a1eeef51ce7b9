"""Batter against bowler, batter by phase, batter against bowling style."""

from pyspark.sql import DataFrame

from creaseline.functions import BATTING_RATES, wilson_lower
from creaseline.operators.rollups import batter_phase_rollup, pair_rollup, summed
from creaseline.operators.styles import bowler_styles
from creaseline.params import Params

_SUMS = ["balls_faced", "runs_scored", "dismissals", "dot_balls", "fours", "sixes"]
_CONFIDENCE = f"{wilson_lower('dismissals', 'balls_faced')} AS dismissal_rate_wilson_lower"


def matchups_from(pairs: DataFrame, params: Params = Params()) -> DataFrame:
    return pairs.filter(
        f"striker IS NOT NULL AND bowler IS NOT NULL AND balls_faced >= {params.h2h_balls}"
    ).selectExpr("striker AS batter", "bowler", *_SUMS, *BATTING_RATES, _CONFIDENCE)


def matchups(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per (batter, bowler) with enough balls between them."""
    return matchups_from(pair_rollup(fact), params)


def batter_phase_from(rollup: DataFrame, params: Params = Params()) -> DataFrame:
    return rollup.filter(
        f"striker IS NOT NULL AND balls_faced >= {params.batter_balls}"
    ).selectExpr("striker AS batter", "phase", *_SUMS, *BATTING_RATES, _CONFIDENCE)


def batter_phase(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per (batter, phase) with enough balls."""
    return batter_phase_from(batter_phase_rollup(fact), params)


def batter_vs_style_from(
    pairs: DataFrame, styles: DataFrame, params: Params = Params()
) -> DataFrame:
    """The style is joined to the pair sums, not to deliveries: the join is small and unskewed.

    Balls of an unnamed bowler count as style 'unknown'.
    """
    styled = (
        pairs.filter("striker IS NOT NULL")
        .join(styles.select("bowler", "bowling_style"), "bowler", "left")
        .selectExpr(
            "striker AS batter", "coalesce(bowling_style, 'unknown') AS bowling_style", *_SUMS
        )
    )
    return (
        summed(styled, ["batter", "bowling_style"], [f"sum({name}) AS {name}" for name in _SUMS])
        .filter(f"balls_faced >= {params.batter_balls}")
        .selectExpr("batter", "bowling_style", *_SUMS, *BATTING_RATES)
    )


def batter_vs_style(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per (batter, bowling style) with enough balls."""
    return batter_vs_style_from(pair_rollup(fact), bowler_styles(fact, params), params)
