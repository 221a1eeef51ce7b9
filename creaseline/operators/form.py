"""Recent form: the last matches of each player and the trend within them."""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.functions import double, half_even, per_over, strike_rate
from creaseline.operators.rollups import summed
from creaseline.params import Params
from creaseline.sources.concurrent import concurrently
from creaseline.sources.storage import written

# How far the later half must move from the earlier half, and the shortest series
# that is judged at all.
BATTER_RISE, BATTER_FALL = 1.15, 0.85
BOWLER_CHEAPER, BOWLER_DEARER = 0.90, 1.10
TREND_MATCHES = 4
# Buckets of matches for each match that is asked for, and the most players whose
# bounds (a name and 8 bytes) are broadcast; more are joined by shuffle.
BUCKETS = 4
BROADCAST_PLAYERS = 500_000

_BATTED = "is_legal AND striker IS NOT NULL AND match_id IS NOT NULL"
_BOWLED = "bowler IS NOT NULL AND match_id IS NOT NULL"
# The first seven bytes of the text as a number: never falls as the text rises.
_CODE = "CAST(conv(rpad(hex(substring(encode(match_id, 'UTF-8'), 1, 7)), 14, '0'), 16, 10) AS BIGINT)"

_TREND = f"""
CASE WHEN sample_matches < {TREND_MATCHES} THEN 'stable'
     WHEN role = 'batter' AND later > earlier * {double(BATTER_RISE)} THEN 'improving'
     WHEN role = 'batter' AND later < earlier * {double(BATTER_FALL)} THEN 'declining'
     WHEN role = 'bowler' AND later < earlier * {double(BOWLER_CHEAPER)} THEN 'improving'
     WHEN role = 'bowler' AND later > earlier * {double(BOWLER_DEARER)} THEN 'declining'
     ELSE 'stable' END"""


def batter_matches(fact: DataFrame) -> DataFrame:
    """(player, match_id): runs, strike rate and outs over legal deliveries."""
    sums = summed(fact.filter(_BATTED), ["striker", "match_id"], [
        "sum(runs_off_bat) AS innings_runs",
        "count(1) AS balls_faced",
        "count_if(is_batter_out) AS outs",
    ])
    return sums.selectExpr(
        "striker AS player", "match_id", "innings_runs", "balls_faced", "outs",
        f"{strike_rate('innings_runs', 'balls_faced')} AS innings_sr",
    )


def bowler_matches(fact: DataFrame) -> DataFrame:
    """(player, match_id): runs, economy and wickets over all deliveries."""
    sums = summed(fact.filter(_BOWLED), ["bowler", "match_id"], [
        "sum(runs_conceded) AS runs_conceded",
        "count_if(is_legal) AS balls_bowled",
        "count_if(is_wicket) AS wickets",
    ])
    return sums.selectExpr(
        "bowler AS player", "match_id", "runs_conceded", "balls_bowled", "wickets",
        f"{per_over('runs_conceded', 'balls_bowled')} AS economy",
    )


def _of_late(known: DataFrame, player: str, last: int) -> DataFrame:
    """The deliveries of each player's last matches and of some before them, all whole. Runs jobs.

    Matches fall into buckets by hash, so the latest of each bucket are different matches: the
    `last` greatest of them bound the last matches from below, whatever the hash. Sums are kept by
    player and bucket, not by match.
    """
    buckets = BUCKETS * last
    bucket = F.expr(f"CAST(pmod(xxhash64(match_id), {buckets}) AS INT)").alias("bucket")
    latest = known.groupBy(player, bucket).agg(F.expr(f"max({_CODE})").alias("code"))
    bounds = latest.groupBy(F.col(player).alias("__player")).agg(
        F.get(F.sort_array(F.collect_list("code"), asc=False), F.lit(last - 1)).alias("__bound")
    )
    # Who has no bound keeps all matches.
    bounds = written(bounds.filter("__bound IS NOT NULL"), "form-bounds")
    if bounds.count() <= BROADCAST_PLAYERS:
        bounds = F.broadcast(bounds)
    late = known.join(bounds, F.col(player) == F.col("__player"), "left")
    return late.filter(f"__bound IS NULL OR {_CODE} >= __bound").drop("__player", "__bound")


def last_batter_matches(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows of `batter_matches`, the last of each player at least."""
    return batter_matches(_of_late(fact.filter(_BATTED), "striker", params.form_matches))


def last_bowler_matches(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows of `bowler_matches`, the last of each player at least."""
    return bowler_matches(_of_late(fact.filter(_BOWLED), "bowler", params.form_matches))


def recent_form_from(
    batters: DataFrame, bowlers: DataFrame, params: Params = Params()
) -> DataFrame:
    """The last matches are those with the greatest `match_id` as text.

    Spark limits each player's rows before the shuffle (WindowGroupLimit), so a player with very
    many matches sends only the last few of each task. The final aggregate keeps the window's
    partitioning.
    """
    per_match = batters.selectExpr(
        "'batter' AS role", "player", "match_id",
        "innings_runs", "innings_sr", "outs", "innings_runs AS measure",
    ).unionByName(
        bowlers.selectExpr(
            "'bowler' AS role", "player", "match_id", "economy", "wickets", "economy AS measure"
        ),
        allowMissingColumns=True,
    )
    recent = (
        per_match
        .selectExpr(
            "*",
            "row_number() OVER (PARTITION BY role, player ORDER BY match_id DESC) AS back",
        )
        .filter(f"back <= {params.form_matches}")
        .selectExpr("*", "count(1) OVER (PARTITION BY role, player) AS size")
        # The earlier half is the first floor(size / 2) matches in ascending order.
        .selectExpr("*", "back <= size - floor(size / 2) AS in_later_half")
    )
    means = summed(recent, ["role", "player"], [
        "avg(innings_runs) AS runs",
        "avg(innings_sr) AS sr",
        "avg(outs) AS outs",
        "avg(economy) AS economy",
        "avg(wickets) AS wickets",
        "avg(measure) FILTER (WHERE in_later_half) AS later",
        "avg(measure) FILTER (WHERE NOT in_later_half) AS earlier",
        "count(1) AS sample_matches",
    ])
    return means.selectExpr(
        "player", "role",
        f"{half_even('runs', 2)} AS recent_avg_runs",
        f"{half_even('sr', 2)} AS recent_avg_sr",
        f"{half_even('outs', 3)} AS recent_dismissal_rate",
        f"{half_even('economy', 2)} AS recent_economy",
        f"{half_even('wickets', 3)} AS recent_wickets_per_match",
        f"{_TREND} AS form_trend",
        "sample_matches",
    )


def recent_form_of(
    batted: DataFrame, bowled: DataFrame, params: Params = Params()
) -> DataFrame:
    """`recent_form` of a fact of its own for each role; their jobs run side by side."""
    batters, bowlers = concurrently(batted.sparkSession, [
        partial(last_batter_matches, batted, params), partial(last_bowler_matches, bowled, params),
    ])
    return recent_form_from(batters, bowlers, params)


def recent_form(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per (player, role). Reads the fact twice for each role, so that matches that cannot be
    among a player's last are dropped before they are summed."""
    return recent_form_of(fact, fact, params)
