"""Compact sums over the delivery fact that several tables share.

Each rollup is one scan with map-side partial aggregation, so a key that holds a large share of the
deliveries reaches the shuffle as one row per task. The full build writes each rollup once and
makes its tables from there. NULL keys are kept here; a table drops them where its keys need it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.functions import BATTING_MEASURES

EARLY_OVERS = 2  # over_int <= 2: the first three overs


def summed(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Aggregate with measures given as SQL text."""
    return rows.groupBy(*keys).agg(*[F.expr(measure) for measure in measures])


def pair_rollup(fact: DataFrame) -> DataFrame:
    """(striker, bowler) sums over legal deliveries."""
    return summed(fact.filter("is_legal"), ["striker", "bowler"], BATTING_MEASURES)


def batter_phase_rollup(fact: DataFrame) -> DataFrame:
    """(striker, phase) sums over legal deliveries."""
    return summed(fact.filter("is_legal"), ["striker", "phase"], BATTING_MEASURES)


def bowler_phase_rollup(fact: DataFrame) -> DataFrame:
    """(bowler, phase) sums: runs and all_wickets over all deliveries, the rest over legal ones."""
    return summed(fact, ["bowler", "phase"], [
        "sum(runs_conceded) AS runs_conceded",
        "count_if(is_legal) AS balls_bowled",
        "count_if(is_legal AND is_wicket) AS wickets",
        "count_if(is_wicket) AS all_wickets",
        "count_if(is_dot) AS dot_balls",
        "count_if(is_boundary4) AS fours_conceded",
        "count_if(is_boundary6) AS sixes_conceded",
        "count_if(is_legal AND over_int <= 5) AS opening_balls",
        "sum(IF(is_legal, runs_conceded, 0D)) AS legal_runs",
    ])


def match_rollup(fact: DataFrame) -> DataFrame:
    """(match_id, venue) innings, phase and early-over sums.

    A sum is NULL where the match has no such delivery, so that later averages skip it.
    """
    early = f"innings = 1 AND over_int <= {EARLY_OVERS}"

    def total(condition, name):
        return f"sum(runs_conceded) FILTER (WHERE {condition}) AS {name}"

    return summed(fact, ["match_id", "venue"], [
        total("innings = 1", "first_innings_runs"),
        total("innings = 2", "second_innings_runs"),
        total("innings = 1 AND phase = 'powerplay'", "powerplay_runs"),
        total("innings = 1 AND phase = 'middle'", "middle_runs"),
        total("innings = 1 AND phase = 'death'", "death_runs"),
        total(early, "early_runs"),
        f"count_if({early} AND is_legal) AS early_balls",
    ])
