"""Batch lookups over the result tables, with a fallback through look-alikes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.sources.storage import written

_MEASURES = [
    "balls_faced", "runs_scored", "dismissals", "dot_balls", "fours", "sixes", "strike_rate",
    "average", "dot_pct", "boundary_pct", "dismissal_rate_wilson_lower",
]


BROADCAST_REQUESTS = 500_000  # distinct requests (short keys) that may be broadcast


def lookup(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of `table` for each distinct request; the request's columns are the key.

    A request without a match yields one row with NULL measures. Up to a fixed number of requests
    are broadcast to a scan of the table, whose few hits then meet the requests; more are joined
    by shuffle.
    """
    keys = requests.columns
    asked = written(requests.distinct(), "requests")
    small = asked.count() <= BROADCAST_REQUESTS
    hits = table.join(F.broadcast(asked) if small else asked, keys)
    return asked.join(hits, keys, "left")


def lookup_one(table: DataFrame, **key) -> DataFrame:
    """Rows for one key; the equality filters reach the Parquet scan of a sorted table."""
    for name, value in key.items():
        table = table.filter(F.col(name) == F.lit(value))
    return table


def matchup_with_fallback(
    requests: DataFrame, matchups: DataFrame, clones: DataFrame
) -> DataFrame:
    """Matchup per requested (batter, bowler); a pair without one takes its best clone's.

    `source_batter`, `similarity` and `clone_rank` say where the row comes from: the batter itself
    (1.0, rank 0), a clone, or nowhere (NULL). Only missing pairs meet the clones.
    """
    pair = ["batter", "bowler"]
    found = written(lookup(matchups, requests.select(*pair)), "asked-pairs")
    hits = found.filter("balls_faced IS NOT NULL").selectExpr(
        *pair, "batter AS source_batter", "1D AS similarity", "0 AS clone_rank", *_MEASURES
    )
    twins = clones.filter("role = 'batter'").selectExpr(
        "player AS batter", "clone AS source_batter", "similarity", "clone_rank"
    )
    stand_ins = matchups.selectExpr("batter AS source_batter", "bowler", *_MEASURES)
    best = ", ".join(["clone_rank", "source_batter", "similarity", *_MEASURES])
    misses = (
        found.filter("balls_faced IS NULL").select(*pair)
        .join(twins, "batter", "left")
        .join(stand_ins, ["source_batter", "bowler"], "left")
        .groupBy(*pair)
        .agg(F.expr(f"min(struct({best})) FILTER (WHERE balls_faced IS NOT NULL) AS best"))
        .select(*pair, "best.source_batter", "best.similarity", "best.clone_rank",
                *[f"best.{name}" for name in _MEASURES])
    )
    return hits.unionByName(misses)
