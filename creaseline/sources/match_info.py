"""Match-information files: ragged `info,key,value` lines to one row per match."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creaseline.functions import whole_number
from creaseline.schema import MATCH_INFO_COLUMNS
from creaseline.sources.deliveries import INFO_MARK, file_name, list_files

# Keys whose value is one field, and keys whose value keeps every remaining field.
SINGLE_KEYS = ["city", "season", "date", "event", "match_number", "toss_decision"]
JOINED_KEYS = ["venue", "toss_winner", "winner", "player_of_match"]
NUMBER_KEYS = ["winner_runs", "winner_wickets"]
LIST_KEY = "team"

_SUFFIX = rf"{INFO_MARK}\.csv$"
# A field behind its comma, and a line whose quotes are all closed. Nothing in them backtracks or
# recurses, so long lines stay linear.
_FIELD = ',((?:[^",]++|"[^"]*+")*+)'
_CLOSED = '^(?:[^"]*+"[^"]*+")*+[^"]*+\\z'
# White space, which is trimmed around lines and fields.
_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def info_files(spark: SparkSession, directory: str) -> DataFrame:
    """Stems that have an information file, even one without a usable line."""
    return (
        list_files(spark, directory)
        .filter(F.col("name").rlike(_SUFFIX))
        .select(F.regexp_replace("name", _SUFFIX, "").alias("match_id"))
    )


def info_lines(spark: SparkSession, directory: str) -> DataFrame:
    """(match_id, at, line); `at` orders the lines of a file, also across its splits."""
    return (
        spark.read.option("pathGlobFilter", f"*{INFO_MARK}.csv").text(directory)
        .select(
            F.regexp_replace(file_name(), _SUFFIX, "").alias("match_id"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("at"),
            F.col("value").alias("line"),
        )
    )


def _clean(field: Column) -> Column:
    """Trim, drop the quotes around a field, undouble those inside."""
    return F.replace(F.btrim(F.btrim(field, F.lit(_SPACE)), F.lit('"')), F.lit('""'), F.lit('"'))


def _fields(line: Column) -> Column:
    """A line's fields. Commas inside quotes belong to their field; if a quote stays open, every
    comma separates. Linear in the line's length, with no expression evaluated per quote."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    closed = F.contains(line, F.lit('"')) & F.rlike(line, F.lit(_CLOSED))
    return F.transform(F.when(closed, quoted).otherwise(F.split(line, ",")), _clean)


def parse_info(lines: DataFrame) -> DataFrame:
    """One row per match from (match_id, at, line); the last line of a key wins.

    Keys never seen give "" (text) or NULL (numbers). Quoted commas belong to their field.
    """
    key, parts = F.col("parts")[1], F.col("parts")
    joined = F.array_join(F.slice("parts", 3, F.size("parts") - 2), ",")
    # Only values that are asked for go on; a match whose lines hold no other keeps its row.
    value = F.when(key.isin(*SINGLE_KEYS, *NUMBER_KEYS), parts[2]).when(key.isin(*JOINED_KEYS, LIST_KEY), joined)
    fields = (
        # The generator keeps the filter above it, so fields are worked out once a line.
        lines.filter(F.contains("line", F.lit("info")))
        .select("match_id", "at", F.explode_outer(F.array(_fields(F.col("line")))).alias("parts"))
        .filter((F.size("parts") >= 3) & (parts[0] == "info"))
        .select("match_id", "at", key.alias("key"), value.alias("value"))
    )

    def last(key, value, valid=None):
        hit = F.col("key") == key
        if valid is not None:
            hit = hit & valid.isNotNull()
        return F.max_by(F.when(hit, value), F.when(hit, F.col("at")))

    count = F.expr(whole_number("value", "BIGINT"))
    teams = F.collect_list(F.when(F.col("key") == LIST_KEY, F.struct("at", "value")))
    return (
        fields.groupBy("match_id")
        .agg(
            *[F.coalesce(last(k, F.col("value")), F.lit("")).alias(k) for k in [*SINGLE_KEYS, *JOINED_KEYS]],
            *[last(k, count, count).alias(k) for k in NUMBER_KEYS],
            F.transform(F.array_sort(teams), lambda team: team["value"]).alias("teams"),
        )
        .select(*MATCH_INFO_COLUMNS)
    )


def pair_info(info: DataFrame, listed: DataFrame, loaded: DataFrame) -> DataFrame:
    """Information rows of the loaded matches that have a file, defaults where it says nothing."""
    text = [*SINGLE_KEYS, *JOINED_KEYS]
    return (
        listed.join(loaded.select(F.col("stem").alias("match_id")), "match_id", "left_semi")
        .join(info, "match_id", "left")
        .withColumns({name: F.coalesce(name, F.lit("")) for name in text})
        .withColumn("teams", F.coalesce("teams", F.array().cast("array<string>")))
        .select(*MATCH_INFO_COLUMNS)
    )


def read_match_info(spark: SparkSession, directory: str, loaded: DataFrame) -> DataFrame:
    """One row per loaded match (`loaded`: its file stem) that has an information file."""
    return pair_info(
        parse_info(info_lines(spark, directory)), info_files(spark, directory), loaded
    )
