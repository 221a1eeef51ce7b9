"""Performance late in a chase of a large total."""

from pyspark.sql import DataFrame

from creaseline.functions import percent, safe_div, scaled_round, strike_rate
from creaseline.operators.rollups import match_rollup, summed
from creaseline.params import Params
from creaseline.schema import TABLE_COLUMNS

_PAIR_SUMS = [
    "count(1) AS balls_faced",
    "sum(runs_off_bat) AS bat_runs",
    "sum(runs_conceded) AS ball_runs",
    "count_if(is_batter_out) AS outs",
    "count_if(is_wicket) AS wickets",
    "count_if(is_boundary4) AS fours",
    "count_if(is_boundary6) AS sixes",
    "count_if(is_dot) AS dot_balls",
]
_SUMS = ["balls_faced", "runs_scored", "dismissals", "fours", "sixes", "dot_balls"]
_SIDES = """
inline(array(
  struct('batter' AS role, striker AS player, bat_runs AS runs_scored, outs AS dismissals),
  struct('bowler' AS role, bowler AS player, ball_runs AS runs_scored, wickets AS dismissals)))"""
_RATES = [
    f"{scaled_round(strike_rate('runs_scored', 'balls_faced'), 2)} AS strike_rate",
    f"{scaled_round(percent('dot_balls', 'balls_faced'), 2)} AS dot_pct",
    f"{scaled_round(percent('fours + sixes', 'balls_faced'), 2)} AS boundary_pct",
    f"{scaled_round(safe_div('dismissals', 'balls_faced'), 4)} AS dismissal_rate",
]


def pressure_matches_from(matches: DataFrame, params: Params = Params()) -> DataFrame:
    """Matches whose first-innings total reaches the threshold."""
    known = matches.filter("match_id IS NOT NULL AND first_innings_runs IS NOT NULL")
    return summed(known, ["match_id"], ["sum(first_innings_runs) AS fi_score"]).filter(
        f"fi_score >= {params.pressure_total}"
    )


def pressure_matches(fact: DataFrame, params: Params = Params()) -> DataFrame:
    return pressure_matches_from(match_rollup(fact), params)


def pressure_from(
    fact: DataFrame, qualifying: DataFrame, params: Params = Params()
) -> DataFrame:
    """One scan: late chase deliveries are summed per match and pair before the semi-join.

    The join then meets short sums instead of deliveries, whatever share one match holds, and both
    roles come out of the same sums.
    """
    chase = fact.filter(
        f"innings = 2 AND over_int >= {params.pressure_over} AND is_legal"
        " AND match_id IS NOT NULL"
    )
    sides = (
        summed(chase, ["match_id", "striker", "bowler"], _PAIR_SUMS)
        .join(qualifying.select("match_id"), "match_id", "left_semi")
        .selectExpr("balls_faced", "fours", "sixes", "dot_balls", _SIDES)
        .filter("player IS NOT NULL")
    )
    scenario = f"inn2_over{params.pressure_over}+_target>={params.pressure_total}"
    return (
        summed(sides, ["role", "player"], [f"sum({name}) AS {name}" for name in _SUMS])
        .filter(f"balls_faced >= {params.pressure_balls}")
        .selectExpr("*", *_RATES, f"'{scenario}' AS pressure_scenario")
        .select(*TABLE_COLUMNS["pressure_performance"])
    )


def pressure(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per (player, role): second innings, late overs, large first-innings total."""
    return pressure_from(fact, pressure_matches(fact, params), params)
