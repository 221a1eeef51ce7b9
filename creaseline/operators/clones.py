"""Statistical look-alikes: per-role feature vectors and their nearest neighbours."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.functions import batting_average, per_over, percent, safe_div, strike_rate
from creaseline.operators.neighbours import nearest
from creaseline.operators.rollups import batter_phase_rollup, bowler_phase_rollup, summed
from creaseline.params import Params
from creaseline.schema import PHASES

BATTER_FEATURES = ["sr", "average", "dot_pct", "boundary_pct", "pp_sr", "mid_sr", "death_sr"]
BOWLER_FEATURES = ["economy", "dot_pct", "wicket_rate", "pp_econ", "mid_econ", "death_econ"]
_PHASE_PREFIX = dict(zip(PHASES, ("pp", "mid", "death")))


def _by_phase(metric: str, suffix: str) -> list[str]:
    """One column per phase from the player's single row of that phase; 0.0 without one."""
    return [
        f"coalesce(max({metric}) FILTER (WHERE phase = '{phase}'), 0D) AS {prefix}_{suffix}"
        for phase, prefix in _PHASE_PREFIX.items()
    ]


def batter_features_from(rollup: DataFrame, params: Params = Params()) -> DataFrame:
    sums = summed(rollup.filter("striker IS NOT NULL"), ["striker"], [
        "sum(balls_faced) AS balls",
        "sum(runs_scored) AS runs",
        "sum(dismissals) AS outs",
        "sum(dot_balls) AS dots",
        "sum(fours + sixes) AS boundaries",
        *_by_phase(strike_rate("runs_scored", "balls_faced"), "sr"),
    ])
    return sums.filter(f"balls >= {params.clone_balls}").selectExpr(
        "striker AS player",
        f"{strike_rate('runs', 'balls')} AS sr",
        f"{batting_average('runs', 'outs', digits=None)} AS average",
        f"{percent('dots', 'balls')} AS dot_pct",
        f"{percent('boundaries', 'balls')} AS boundary_pct",
        "pp_sr", "mid_sr", "death_sr",
    )


def bowler_features_from(rollup: DataFrame, params: Params = Params()) -> DataFrame:
    sums = summed(rollup.filter("bowler IS NOT NULL"), ["bowler"], [
        "sum(balls_bowled) AS balls",
        "sum(runs_conceded) AS runs",
        "sum(all_wickets) AS wickets",
        "sum(dot_balls) AS dots",
        *_by_phase(per_over("runs_conceded", "balls_bowled"), "econ"),
    ])
    return sums.filter(f"balls >= {params.clone_balls}").selectExpr(
        "bowler AS player",
        f"{per_over('runs', 'balls')} AS economy",
        f"{percent('dots', 'balls')} AS dot_pct",
        f"{percent('wickets', 'balls')} AS wicket_rate",
        "pp_econ", "mid_econ", "death_econ",
    )


def clone_features(fact: DataFrame, role: str, params: Params = Params()) -> DataFrame:
    if role == "batter":
        return batter_features_from(batter_phase_rollup(fact), params)
    return bowler_features_from(bowler_phase_rollup(fact), params)


def standardised(features: DataFrame, names: list[str], role: str) -> DataFrame:
    """(role, player, z): population z-scores; a feature without spread becomes 0."""
    moments = summed(features, [], [
        *[f"avg({name}) AS {name}_mean" for name in names],
        *[f"stddev_pop({name}) AS {name}_std" for name in names],
        f"'{role}' AS role",
    ])
    z = ", ".join(safe_div(f"{name} - {name}_mean", f"{name}_std") for name in names)
    # The moments are one row by construction.
    return (
        features.selectExpr("*", f"'{role}' AS role")
        .join(F.broadcast(moments), "role")
        .selectExpr("role", "player", f"array({z}) AS z")
    )


def unit_vectors(features: DataFrame, names: list[str], role: str) -> DataFrame:
    """(role, player, unit): z-score vectors scaled to length 1.

    A player exactly at the mean has no direction, hence no similarity, and is left out.
    """
    return (
        standardised(features, names, role)
        .selectExpr("*", "sqrt(aggregate(z, 0D, (total, x) -> total + x * x)) AS norm")
        .filter("norm > 0")
        .selectExpr("role", "player", "transform(z, x -> x / norm) AS unit")
    )


def clones_from(
    batters: DataFrame, bowlers: DataFrame, params: Params = Params(), leaf_size: int = 2048
) -> DataFrame:
    """Runs jobs: the vectors are written and the search is planned on their count."""
    vectors = unit_vectors(batters, BATTER_FEATURES, "batter").unionByName(
        unit_vectors(bowlers, BOWLER_FEATURES, "bowler")
    )
    return nearest(vectors, params.clone_top_k, leaf_size)


def clones(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """The most similar players of the same role, best first."""
    return clones_from(
        clone_features(fact, "batter", params), clone_features(fact, "bowler", params), params
    )
