"""Venue scoring profiles and the surface behaviour index."""

from pyspark.sql import DataFrame

from creaseline.functions import per_over, scaled_round
from creaseline.operators.medians import grouped_median
from creaseline.operators.rollups import match_rollup, summed
from creaseline.schema import TABLE_COLUMNS

EARLY_BALLS_DEFAULT = 18  # fixed value: stands in when a match has no legal early ball

_PHASE_MEANS = [
    f"{scaled_round(f'coalesce(avg({phase}_runs), 0D)', 1)} AS avg_{phase}_runs"
    for phase in ("powerplay", "middle", "death")
]


def innings_totals(fact: DataFrame) -> DataFrame:
    """Runs per (match_id, venue, innings)."""
    return summed(
        fact.filter("match_id IS NOT NULL AND venue IS NOT NULL AND innings IS NOT NULL"),
        ["match_id", "venue", "innings"], ["sum(runs_conceded) AS total_runs"],
    )


def _known(matches: DataFrame) -> DataFrame:
    return matches.filter("match_id IS NOT NULL AND venue IS NOT NULL")


def venue_phase_runs_from(matches: DataFrame) -> DataFrame:
    """Mean first-innings runs per phase; a match without a phase does not dilute its mean."""
    means = ["count(first_innings_runs) AS matches_played", *_PHASE_MEANS]
    return summed(_known(matches), ["venue"], means).filter("matches_played > 0")


def early_economy_from(matches: DataFrame) -> DataFrame:
    """First-innings economy over the first three overs, per (match_id, venue)."""
    balls = f"IF(early_balls = 0, {EARLY_BALLS_DEFAULT}, early_balls)"
    return (
        _known(matches)
        .filter("early_runs IS NOT NULL")
        .selectExpr("match_id", "venue", f"{per_over('early_runs', balls)} AS early_econ")
    )


def surface_index_from(matches: DataFrame) -> DataFrame:
    """Venue median of early economy over the median of all matches."""
    early = early_economy_from(matches)
    overall = grouped_median(early.selectExpr("1 AS everything", "early_econ"), ["everything"],
                             "early_econ")
    venues = grouped_median(early, ["venue"], "early_econ")
    return venues.select(
        "venue", "median", overall.select("median").scalar().alias("baseline")
    ).selectExpr(
        "venue", "median AS venue_early_econ",
        f"{scaled_round('IF(baseline = 0, 0D, median / baseline)', 3)} AS surface_behavior_index",
    )


def toss_counts(info: DataFrame) -> DataFrame:
    """Per venue, matches whose toss winner chose to field (both counts are the same by design)."""
    return summed(
        info.filter("toss_decision = 'field' AND venue IS NOT NULL"), ["venue"],
        ["count(winner) AS chase_wins", "count(winner) AS total_tosses"],
    )


def venue_profiles_from(matches: DataFrame, info: DataFrame | None = None) -> DataFrame:
    scores = summed(_known(matches), ["venue"], [
        f"{scaled_round('avg(first_innings_runs)', 1)} AS avg_first_innings_score",
        "count(first_innings_runs) AS matches_played",
        f"{scaled_round('avg(second_innings_runs)', 1)} AS avg_second_innings_score",
        *_PHASE_MEANS,
    ]).filter("matches_played > 0")
    surface = surface_index_from(matches).select("venue", "surface_behavior_index")
    profiles = scores.join(surface, "venue", "left").fillna(1.0, "surface_behavior_index")
    columns = TABLE_COLUMNS["venue_profiles"]
    if info is None:
        return profiles.select(*columns[:-2])
    return (
        profiles.join(toss_counts(info), "venue", "left").fillna(0, columns[-2:]).select(*columns)
    )


def venue_profiles(fact: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """One row per venue with a first innings; toss counts only when match information is given."""
    return venue_profiles_from(match_rollup(fact), info)
