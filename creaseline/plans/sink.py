"""Stored result tables: layout, replacement and the report after writing."""

from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from creaseline.schema import TABLE_COLUMNS
from creaseline.sources.concurrent import concurrently

# Sort keys per table: the columns readers look rows up by. Every list ends in a unique key, so a
# player with very many rows still spreads over several files. A leading minus sorts descending.
LAYOUT = {
    "matchups_1v1": ["batter", "-balls_faced", "bowler"],
    "bowler_phase_stats": ["bowler", "phase"],
    "batter_phase_stats": ["batter", "phase"],
    "venue_profiles": ["venue"],
    "batter_vs_bowling_style": ["batter", "bowling_style"],
    "recent_form": ["player", "role"],
    "player_clones": ["player", "role", "clone_rank"],
    "pressure_performance": ["player", "role"],
}

# Second copies for the access paths that the main order does not serve.
SECOND_LAYOUT = {
    "matchups_1v1": ["bowler", "batter"],
    "bowler_phase_stats": ["phase", "bowling_archetype", "bowler"],
    "batter_phase_stats": ["phase", "batter"],
    "batter_vs_bowling_style": ["bowling_style", "batter"],
    "player_clones": ["role", "player", "clone_rank"],
}


def table_path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}"


def index_path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/by_second_key/{name}"


def write_tables(tables: dict[str, DataFrame], directory: str) -> list[str]:
    """Replace each table by its new rows; the names of the stored tables.

    An empty table is skipped and its older rows survive. Rows are range-partitioned and sorted on
    the lookup keys, so Parquet min/max statistics let a lookup skip files and row groups.
    """
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    jobs = [partial(_write_table, name, table, directory) for name, table in tables.items()]
    return [name for name, stored in zip(tables, concurrently(spark, jobs)) if stored]


def _write_table(name: str, table: DataFrame, directory: str) -> bool:
    # Read several times: emptiness, range bounds, one or two layouts.
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if table.isEmpty():
            return False
        _write_sorted(table, LAYOUT.get(name, table.columns[:1]), table_path(directory, name))
        if name in SECOND_LAYOUT:
            _write_sorted(table, SECOND_LAYOUT[name], index_path(directory, name))
        return True
    finally:
        table.unpersist()


def _write_sorted(table: DataFrame, keys: list[str], path: str) -> None:
    keys = [F.desc(key[1:]) if key.startswith("-") else F.asc(key) for key in keys]
    (
        table.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .write.mode("overwrite").parquet(path)
    )


def read_table(
    spark: SparkSession, directory: str, name: str, by: str | None = None
) -> DataFrame:
    """A stored table; `by` names the lookup column and picks the copy whose order serves it."""
    main, second = LAYOUT.get(name, []), SECOND_LAYOUT.get(name, [])
    if by in second and by != main[0]:
        return spark.read.parquet(index_path(directory, name))
    return spark.read.parquet(table_path(directory, name))


def table_report(spark: SparkSession, directory: str) -> DataFrame:
    """(table_name, row_count, status) of the tables found in storage."""
    report = None
    for name in TABLE_COLUMNS:
        try:
            table = read_table(spark, directory, name)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        line = table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.when(F.col("row_count") > 0, "OK").otherwise("EMPTY").alias("status"),
        )
        report = line if report is None else report.unionByName(line)
    if report is None:
        return spark.createDataFrame([], "table_name string, row_count bigint, status string")
    return report
