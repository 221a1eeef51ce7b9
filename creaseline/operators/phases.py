"""Bowler by phase."""

from pyspark.sql import DataFrame

from creaseline.functions import per_over, percent, safe_div, scaled_round
from creaseline.operators.rollups import bowler_phase_rollup
from creaseline.params import Params

NO_WICKET = 999.0  # fixed value: strike rate and average of a bowler without a wicket

_RATES = [
    f"{scaled_round(per_over('runs_conceded', 'balls_bowled'), 2)} AS economy",
    f"{scaled_round(safe_div('balls_bowled', 'wickets', NO_WICKET), 2)} AS bowling_sr",
    f"{scaled_round(safe_div('runs_conceded', 'wickets', NO_WICKET), 2)} AS average",
    f"{scaled_round(percent('dot_balls', 'balls_bowled'), 2)} AS dot_pct",
    f"{scaled_round(percent('fours_conceded + sixes_conceded', 'balls_bowled'), 2)}"
    " AS boundary_concede_pct",
]


def bowler_phase_from(rollup: DataFrame, params: Params = Params()) -> DataFrame:
    return rollup.filter(
        f"bowler IS NOT NULL AND balls_bowled >= {max(params.bowler_balls, 1)}"
    ).selectExpr(
        "bowler", "phase", "runs_conceded", "balls_bowled", "wickets", "dot_balls",
        "fours_conceded", "sixes_conceded", *_RATES,
    )


def bowler_phase(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per (bowler, phase) with enough legal balls; the archetype is added separately."""
    return bowler_phase_from(bowler_phase_rollup(fact), params)
