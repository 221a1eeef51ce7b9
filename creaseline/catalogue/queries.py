"""Every operator as a query over the test tables: (spark, sf_dir) -> DataFrame."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creaseline.functions import scaled_round
from creaseline.operators import (
    archetypes, clones, form, lookup, matchups, phases, pressure, rollups, styles, summary, venues,
)
from creaseline.params import Params
from creaseline.plans.build import FACT_COLUMNS, build_tables
from creaseline.plans.sink import read_table, table_report, write_tables
from creaseline.schema import DELIVERY_COLUMNS
from creaseline.sources import testdata
from creaseline.sources.deliveries import read_deliveries
from creaseline.sources.match_info import parse_info
from creaseline.sources.storage import scratch_path, written
from creaseline.sources.testdata import fact

PARAMS = Params()
INFO_MATCHES = 250  # matches whose information lines one task derives and parses
_FLAGS = [
    "is_wide", "is_noball", "is_legal", "is_wicket", "is_batter_out", "is_boundary4",
    "is_boundary6", "is_dot", "runs_conceded", "over_int", "phase",
]


def _nullable_counts(frame: DataFrame, names: list[str]) -> DataFrame:
    """Counts that may be missing as DOUBLE, which every client shows alike."""
    return frame.withColumns({name: F.col(name).cast("double") for name in names})


def delivery_features(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d, "striker", "bowler").select(
        "match_id", "innings", "ball", "striker", "bowler", *_FLAGS
    )


def load_summary(spark, d):
    return summary.load_summary(testdata.deliveries(spark, d, ["season"])).withColumn(
        "seasons", F.array_join("seasons", ",")
    )


def feature_summary(spark, d):
    return summary.feature_summary(fact(spark, d))


def matchups_1v1(spark, d):
    return matchups.matchups(fact(spark, d, "striker", "bowler"), PARAMS)


def matchups_presented(spark, d):
    """Matchups with the rank each row has in presentation order (batter, most balls first)."""
    order = Window.partitionBy("batter").orderBy(F.desc("balls_faced"), "bowler")
    ranked = matchups_1v1(spark, d).withColumn("presented", F.row_number().over(order))
    return ranked.orderBy("batter", "presented")


def bowler_phase_stats(spark, d):
    return phases.bowler_phase(fact(spark, d, "bowler"), PARAMS)


def batter_phase_stats(spark, d):
    return matchups.batter_phase(fact(spark, d, "striker"), PARAMS)


def bowler_style(spark, d):
    return styles.bowler_styles(fact(spark, d, "bowler"), PARAMS)


def deliveries_by_style(spark, d):
    bowled = fact(spark, d, "bowler")
    styled = styles.attach_styles(bowled, styles.bowler_styles(bowled, PARAMS))
    return styled.groupBy("bowling_style").agg(
        F.count(F.lit(1)).alias("deliveries"), F.sum("runs_conceded").alias("runs_conceded")
    )


def batter_vs_bowling_style(spark, d):
    return matchups.batter_vs_style_from(
        rollups.pair_rollup(fact(spark, d, "striker", "bowler")),
        styles.bowler_styles(fact(spark, d, "bowler"), PARAMS),
        PARAMS,
    )


def innings_totals(spark, d):
    return venues.innings_totals(fact(spark, d))


def venue_phase_runs(spark, d):
    return venues.venue_phase_runs_from(rollups.match_rollup(fact(spark, d)))


def early_economy(spark, d):
    early = venues.early_economy_from(rollups.match_rollup(fact(spark, d)))
    return early.withColumn("early_econ", F.expr(scaled_round("early_econ", 6)))


def surface_behavior_index(spark, d):
    index = venues.surface_index_from(rollups.match_rollup(fact(spark, d)))
    return index.select("venue", "surface_behavior_index")


def toss_counts(spark, d):
    return venues.toss_counts(testdata.match_info(spark, d))


def venue_profiles(spark, d):
    return venues.venue_profiles(fact(spark, d), testdata.match_info(spark, d))


def pressure_matches(spark, d):
    return pressure.pressure_matches(fact(spark, d), PARAMS)


def pressure_performance(spark, d):
    qualifying = pressure.pressure_matches(fact(spark, d), PARAMS)
    return pressure.pressure_from(fact(spark, d, "striker", "bowler"), qualifying, PARAMS)


def batter_matches(spark, d):
    per_match = form.batter_matches(fact(spark, d, "striker"))
    return per_match.withColumn("innings_sr", F.expr(scaled_round("innings_sr", 6)))


def bowler_matches(spark, d):
    per_match = form.bowler_matches(fact(spark, d, "bowler"))
    return per_match.withColumn("economy", F.expr(scaled_round("economy", 6)))


def recent_form(spark, d):
    return form.recent_form_of(fact(spark, d, "striker"), fact(spark, d, "bowler"), PARAMS)


def _clone_features(spark, d, role):
    key = {"batter": "striker", "bowler": "bowler"}[role]
    return clones.clone_features(fact(spark, d, key), role, PARAMS)


def _rounded(features: DataFrame, names: list[str]) -> DataFrame:
    return features.withColumns({n: F.expr(scaled_round(n, 6)) for n in names})


def clone_features_batter(spark, d):
    return _rounded(_clone_features(spark, d, "batter"), clones.BATTER_FEATURES)


def clone_features_bowler(spark, d):
    return _rounded(_clone_features(spark, d, "bowler"), clones.BOWLER_FEATURES)


def player_clones(spark, d):
    return clones.clones_from(
        _clone_features(spark, d, "batter"), _clone_features(spark, d, "bowler"), PARAMS
    )


def archetype_features(spark, d):
    return _rounded(
        archetypes.archetype_features(bowler_phase_stats(spark, d)), archetypes.FEATURES
    )


def bowling_archetypes(spark, d):
    """The complete bowler_phase_stats table, archetype included."""
    return archetypes.with_archetypes(bowler_phase_stats(spark, d), PARAMS)


def bowling_archetype_join(spark, d):
    """The joined bowler_phase_stats table without the label itself."""
    return bowling_archetypes(spark, d).drop("bowling_archetype")


def archetype_check(spark, d):
    """Whether every bowler's archetype is the nearest and every claim holds."""
    stats = written(bowler_phase_stats(spark, d), "bowler-phase")
    career = archetypes.archetype_features(stats)
    return archetypes.archetype_check(career, archetypes.archetypes(stats, PARAMS))


def table_lookup(spark, d):
    """Every supplier's death-over row, asked for in one batch of the stored table."""
    path = scratch_path(spark, "lookup-tables")
    labelled = bowler_phase_stats(spark, d).withColumn("bowling_archetype", F.lit("unknown"))
    write_tables({"bowler_phase_stats": labelled}, path)
    table = read_table(spark, path, "bowler_phase_stats", by="phase").drop("bowling_archetype")
    requests = spark.read.parquet(f"{d}/supplier.parquet").select(
        F.col("s_name").alias("bowler"), F.lit("death").alias("phase")
    )
    counts = ["balls_bowled", "wickets", "dot_balls", "fours_conceded", "sixes_conceded"]
    return _nullable_counts(lookup.lookup(table, requests), counts)


def matchup_with_fallback(spark, d):
    """Every pair that ever met is asked for; pairs below the threshold fall back to clones."""
    pairs = written(rollups.pair_rollup(fact(spark, d, "striker", "bowler")), "pairs")
    requests = pairs.select(F.col("striker").alias("batter"), "bowler")
    found = lookup.matchup_with_fallback(
        requests, matchups.matchups_from(pairs, PARAMS), player_clones(spark, d)
    )
    counts = ["clone_rank", "balls_faced", "dismissals", "dot_balls", "fours", "sixes"]
    return _nullable_counts(found, counts)


def ingest_deliveries(spark, d):
    """Deliveries written as CSV files by Spark and read back through the file reader."""
    path = scratch_path(spark, "delivery-csv")
    testdata.deliveries(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return read_deliveries(spark, path).deliveries.select(*DELIVERY_COLUMNS)


def ingest_match_info(spark, d):
    """Information lines derived from each match, parsed back into one row per match."""
    info = written(testdata.match_info(spark, d), "matches")
    # A few bytes of a match turn into long lines: tasks are cut by matches, not by their stored size.
    info = info.repartition(1 + info.count() // INFO_MATCHES, "match_id")
    lines = """posexplode(array(
        'version,2.1.0',
        concat('info,team,Home ', match_id),
        concat('info,team, Away ', match_id),
        'info,city,Nowhere',
        concat('info,event,Cup of St John"s ', match_id),
        concat('info,date,\t2020/01/0', CAST(match_id AS BIGINT) % 9 + 1, '\t'),
        concat('info,season,"', repeat('"",', 12500), '"'),
        'info,season,2020',
        concat('info,city,', venue),
        concat('info,venue,"', venue, ', Ground"'),
        concat('info,toss_decision,', toss_decision),
        concat('info,winner,', winner),
        concat('info,winner_runs,',
               IF(CAST(match_id AS BIGINT) % 5 = 0, 'none',
                  CAST(CAST(match_id AS BIGINT) % 90 AS STRING))),
        concat('info,player_of_match,Surname, ', match_id),
        concat('info,registry,people,Somebody,', match_id),
        'info,umpire')) AS (at, line)"""
    parsed = parse_info(info.selectExpr("match_id", lines))
    return _nullable_counts(
        parsed.withColumn("teams", F.array_join("teams", "|")), ["winner_runs", "winner_wickets"]
    )


def table_report_query(spark, d):
    """All eight tables built, stored and counted from storage."""
    path = scratch_path(spark, "tables")
    deliveries = written(fact(spark, d, "striker", "bowler").select(*FACT_COLUMNS), "fact")
    write_tables(build_tables(deliveries, testdata.match_info(spark, d), PARAMS), path)
    return table_report(spark, path)


QUERIES = {
    "matchups_1v1": matchups_1v1,
    "matchups_presented": matchups_presented,
    "bowler_phase_stats": bowler_phase_stats,
    "batter_phase_stats": batter_phase_stats,
    "bowler_style": bowler_style,
    "deliveries_by_style": deliveries_by_style,
    "batter_vs_bowling_style": batter_vs_bowling_style,
    "innings_totals": innings_totals,
    "venue_phase_runs": venue_phase_runs,
    "early_economy": early_economy,
    "surface_behavior_index": surface_behavior_index,
    "toss_counts": toss_counts,
    "venue_profiles": venue_profiles,
    "pressure_matches": pressure_matches,
    "pressure_performance": pressure_performance,
    "batter_matches": batter_matches,
    "bowler_matches": bowler_matches,
    "recent_form": recent_form,
    "clone_features_batter": clone_features_batter,
    "clone_features_bowler": clone_features_bowler,
    "player_clones": player_clones,
    "archetype_features": archetype_features,
    "bowling_archetypes": bowling_archetypes,
    "bowling_archetype_join": bowling_archetype_join,
    "archetype_check": archetype_check,
    "table_lookup": table_lookup,
    "matchup_with_fallback": matchup_with_fallback,
    "delivery_features": delivery_features,
    "load_summary": load_summary,
    "feature_summary": feature_summary,
    "ingest_deliveries": ingest_deliveries,
    "ingest_match_info": ingest_match_info,
    "table_report": table_report_query,
}
