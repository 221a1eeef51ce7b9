"""All tables from one delivery fact, and the run from files to stored tables."""

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from creaseline.operators.archetypes import with_archetypes
from creaseline.operators.clones import (
    batter_features_from, bowler_features_from, clones_from,
)
from creaseline.operators.features import enrich
from creaseline.operators.form import recent_form
from creaseline.operators.matchups import (
    batter_phase_from, batter_vs_style_from, matchups_from,
)
from creaseline.operators.phases import bowler_phase_from
from creaseline.operators.pressure import pressure_from, pressure_matches_from
from creaseline.operators.rollups import (
    batter_phase_rollup, bowler_phase_rollup, match_rollup, pair_rollup,
)
from creaseline.operators.styles import bowler_styles_from
from creaseline.operators.venues import venue_profiles_from
from creaseline.params import Params
from creaseline.plans.sink import write_tables
from creaseline.sources.concurrent import concurrently
from creaseline.sources.deliveries import read_deliveries
from creaseline.sources.match_info import read_match_info
from creaseline.sources.storage import run_folder, written


# All that the tables read of a delivery; nothing else is stored.
FACT_COLUMNS = [
    "match_id", "venue", "innings", "striker", "bowler", "phase", "over_int", "runs_off_bat",
    "runs_conceded", "is_legal", "is_wicket", "is_batter_out", "is_dot", "is_boundary4", "is_boundary6",
]


def build_tables(
    fact: DataFrame, info: DataFrame | None = None, params: Params = Params()
) -> dict[str, DataFrame]:
    """The eight result tables.

    Runs jobs: the four rollups are written once, after which only recent form and pressure scan
    the fact again. Store the fact first; every rollup reads it.
    """
    rollups = {
        "pairs": pair_rollup, "batter-phases": batter_phase_rollup,
        "bowler-phases": bowler_phase_rollup, "matches": match_rollup,
    }
    spark = fact.sparkSession
    pairs, batter_phases, bowler_phases, matches = concurrently(
        spark, [partial(written, roll(fact), label) for label, roll in rollups.items()]
    )
    # The first two run many small jobs while they plan, beside which the scans of recent form fit.
    bowler_table, clone_table, form_table = concurrently(spark, [
        lambda: with_archetypes(bowler_phase_from(bowler_phases, params), params),
        lambda: clones_from(
            batter_features_from(batter_phases, params),
            bowler_features_from(bowler_phases, params), params,
        ),
        lambda: recent_form(fact, params),
    ])
    styles = bowler_styles_from(bowler_phases, params)
    return {
        "matchups_1v1": matchups_from(pairs, params),
        "bowler_phase_stats": bowler_table,
        "batter_phase_stats": batter_phase_from(batter_phases, params),
        "venue_profiles": venue_profiles_from(matches, info),
        "batter_vs_bowling_style": batter_vs_style_from(pairs, styles, params),
        "recent_form": form_table,
        "player_clones": clone_table,
        "pressure_performance": pressure_from(
            fact, pressure_matches_from(matches, params), params
        ),
    }


def run(
    spark: SparkSession, matches_dir: str, out_dir: str, params: Params = Params()
) -> list[str]:
    """Read match files, build all tables, store them; the names of the stored tables.

    Intermediates live in the shared folder for the length of the run.
    """
    with run_folder(spark):
        source = read_deliveries(spark, matches_dir)
        info = written(read_match_info(spark, matches_dir, source.loaded), "match-info")
        fact = written(enrich(source.deliveries).select(*FACT_COLUMNS), "fact")
        tables = build_tables(fact, None if info.isEmpty() else info, params)
        return write_tables(tables, out_dir)
