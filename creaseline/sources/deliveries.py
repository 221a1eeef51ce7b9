"""Delivery CSV files: discovery, header drift, quarantine, typing."""

import csv
import re
import warnings
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.functions import number_or_zero, whole_number
from creaseline.schema import BLANK_COLUMNS, DELIVERY_COLUMNS, NUMERIC_COLUMNS
from creaseline.sources.storage import written

INFO_MARK = "_info"
_CORRUPT = "_corrupt"
# Quoted text, removed before separators are counted; doubled quotes simply end and start one.
_QUOTED = '"[^"]*"'


def file_name() -> Column:
    """Plain file name of the row's file; the metadata column holds it percent-encoded."""
    return _decoded(F.col("_metadata.file_name"))


def _decoded(encoded: Column) -> Column:
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, name, length) of every CSV file that is not empty; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory)
        .select(
            F.col("_metadata.file_path").alias("path"), file_name().alias("name"), "length"
        )
    )


def hidden_files(spark: SparkSession, directory: str) -> list[str]:
    """Names of the CSV files that Spark leaves out without a word: those that start with _ or dot."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(directory, "[_.]*.csv")
    found = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
    return sorted(status.getPath().getName() for status in found or ())


def _listed_names(spark: SparkSession, directory: str) -> list[str]:
    """Percent-encoded names of all listed delivery files, empty ones included: one listing."""
    listed = spark.read.option("pathGlobFilter", "*.csv").text(directory).inputFiles()
    return [name for path in listed if INFO_MARK not in (name := path.rsplit("/", 1)[-1])]


@dataclass(frozen=True)
class DeliverySource:
    """Typed deliveries and the per-file account they came from.

    `files` has (path, stem, header, reason); `reason` is NULL for a loaded file.
    """

    deliveries: DataFrame
    files: DataFrame

    @property
    def loaded(self) -> DataFrame:
        """Stems of the loaded files, those without any delivery included."""
        return self.files.filter("reason is null").select("stem")

    @property
    def quarantined(self) -> DataFrame:
        return self.files.filter("reason is not null").select("stem", "reason")


def _raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines that are not blank; `line` orders those of a file's first block."""
    return (
        spark.read.option("pathGlobFilter", "*.csv").text(paths)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        .filter(~F.col("_metadata.file_name").contains(INFO_MARK) & (F.trim("value") != ""))
    )


def _digests(text: Column) -> list[Column]:
    """128 bits of a line in two numbers."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _text_files(spark: SparkSession, directory: str) -> DataFrame:
    """One row per file with a line, from one pass over the raw lines, combined map-side.

    All that is gathered of a line are numbers, so the sums need no sort of the lines; a header's text
    is read from one file of those that share its digest.
    """
    value = F.col("value")
    quotes = _count(value, '"')
    # Empty quoted text holds no separator, so only lines with other quotes need the pattern.
    filled = F.contains(F.replace(value, F.lit('""'), F.lit("")), F.lit('"'))
    bare = F.when(filled, F.regexp_replace(value, _QUOTED, "")).otherwise(value)
    first = F.when(F.col("block") == 0, F.col("line"))
    files = written(
        _raw_lines(spark, directory).groupBy("path").agg(
            *[F.min_by(digest, first).alias(f"digest_{i}") for i, digest in enumerate(_digests(value))],
            F.max(_count(bare, ",") + 1).alias("fields"),
            F.sum(quotes).alias("quotes"),
            F.max(quotes % 2).alias("open_quotes"),
            F.max((~F.is_valid_utf8(value)).cast("int")).alias("bad_text"),
        ),
        "file-lines",
    )
    shared = ["digest_0", "digest_1"]
    # One row for each distinct layout.
    samples = files.groupBy(*shared).agg(F.min("path").alias("path")).collect()
    known = [(row["digest_0"], row["digest_1"]) for row in samples]
    texts = (
        _raw_lines(spark, [_unescaped(row["path"]) for row in samples]).filter("block = 0")
        .select(*[digest.alias(name) for name, digest in zip(shared, _digests(value))], F.col("value").alias("header"))
        .join(F.broadcast(spark.createDataFrame(known, "digest_0 bigint, digest_1 bigint")), shared, "left_semi")
        .groupBy(*shared).agg(F.min("header").alias("header"))
        if samples else spark.createDataFrame([], "digest_0 bigint, digest_1 bigint, header string")
    )
    headers = spark.createDataFrame(texts.collect(), texts.schema)
    files = files.join(F.broadcast(headers), shared).drop(*shared)
    return files.withColumn("encoded", F.substring_index("path", "/", -1)).withColumn("name", _decoded(F.col("encoded")))


def _count(text: Column, sign: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def _parse_header(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("﻿")]))


def _raw_rows(spark, paths: str | list[str], width: int, spanning: bool) -> DataFrame:
    """Files read by position, `width` text columns, NULL for empty text, quoted or not; the reader drops
    each file's header."""
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(width)]
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .options(
            header=True, escape='"', multiLine=spanning, mode="PERMISSIVE",
            columnNameOfCorruptRecord=_CORRUPT, pathGlobFilter="*.csv", nullValue="", emptyValue="",
        )
        .csv(paths)
        .filter(~F.col("_metadata.file_name").contains(INFO_MARK))
        .select("*", F.col("_metadata.file_path").alias("path"))
    )


def _overlong_records(rows: DataFrame, files: DataFrame, width: int) -> DataFrame:
    """Paths of files with a record longer than their header, where records may span lines."""
    seen = F.when(F.col(_CORRUPT).isNull(), F.lit(width)).otherwise(
        _count(F.regexp_replace(_CORRUPT, _QUOTED, ""), ",") + 1
    )
    # Spark refuses a scan of the raw record alone, so the first field is looked at as well.
    filled = F.col("_c0").isNotNull() | F.col(_CORRUPT).isNotNull()
    return (
        rows.groupBy("path").agg(F.max(F.when(filled, seen)).alias("longest"))
        .join(files.select("path", "width"), "path")
        .filter("longest > width")
        .select("path", F.lit(True).alias("overlong"))
    )


def read_deliveries(spark: SparkSession, directory: str) -> DeliverySource:
    """Read every delivery file of a directory into one typed DataFrame, matched by column name.

    One pass over the raw lines learns each file's header and quarantines what cannot be parsed; the
    result itself stays lazy. Every file is accounted for: an empty one, and one that Spark hides
    for its name, are listed with a reason.

    Files may differ in their headers, yet are read in one splittable scan by position: the distinct
    layouts turn into one projection. If every file is sound and has the commonest layout, the scan
    stands alone; else the exceptions, written apart, are looked up by path. Only the sound files in
    which a quoted field spans lines are read whole.
    """
    listed, hidden = _listed_names(spark, directory), hidden_files(spark, directory)
    if not listed:
        raise FileNotFoundError(f"no delivery CSV files in {directory}")
    files = written(_text_files(spark, directory), "files")
    headers = [
        row["header"]
        for row in files.groupBy("header").count().orderBy(F.desc("count"), "header").collect()
    ]  # distinct layouts
    if not headers:
        raise FileNotFoundError(f"all delivery CSV files in {directory} are empty")
    layouts = {i: _parse_header(header) for i, header in enumerate(headers)}
    known = spark.createDataFrame(
        [(header, i, len(layouts[i])) for i, header in enumerate(headers)],
        "header string, layout int, width int",
    )
    width = max(len(names) for names in layouts.values())
    spanning = (F.col("open_quotes") == 1) & (F.col("bad_text") == 0) & (F.col("quotes") % 2 == 0)
    files = files.join(known, "header").withColumn("spanning", spanning)
    whole = [row["path"] for row in files.filter("spanning").select("path").collect()]
    spanned = _raw_rows(spark, [_unescaped(path) for path in whole], width, True) if whole else None
    files = files.withColumn("overlong", ~F.col("spanning") & (F.col("fields") > F.col("width")))
    if whole:
        longer = _overlong_records(spanned, files, width).withColumnRenamed("overlong", "longer")
        files = files.join(longer, "path", "left").withColumn("overlong", F.col("overlong") | F.coalesce("longer", F.lit(False)))
    reason = (
        F.when(F.col("bad_text") == 1, "not UTF-8")
        .when(F.col("quotes") % 2 == 1, "unclosed quote")
        .when(F.col("overlong"), "more fields than the header")
    )
    files = written(
        files.select("path", _stem(F.col("name")), "header", "layout", "spanning", "encoded", reason.alias("reason")),
        "file-account",
    )
    account = files.select("path", "stem", "header", "reason")
    names = spark.createDataFrame([(name,) for name in listed], "encoded string")
    empty = names.join(files, "encoded", "left_anti").withColumn("name", _decoded(F.col("encoded")))
    unread = empty.select("name", F.lit("empty").alias("reason"))
    if hidden:
        unread = unread.union(spark.createDataFrame([(n, "hidden by its name") for n in hidden if INFO_MARK not in n], "name string, reason string"))
    account = account.unionByName(
        unread.select(F.lit(None).cast("string").alias("path"), _stem(F.col("name")), F.lit(None).cast("string").alias("header"), "reason")
    )
    bad = account.filter("reason is not null").count()
    if bad:
        warnings.warn(f"{bad} delivery files quarantined in {directory}", stacklevel=2)
    if files.filter("reason is null").isEmpty():
        raise ValueError(f"no delivery file in {directory} could be loaded")

    exceptions = files.filter("layout > 0 or spanning or reason is not null").select(
        "path", "layout", "spanning", F.col("reason").isNotNull().alias("skip")
    )
    rows = _raw_rows(spark, directory, width, False).drop(_CORRUPT)
    if exceptions.isEmpty():
        placed = rows.withColumn("layout", F.lit(0))
    else:
        exceptions = written(exceptions, "file-exceptions")
        placed = rows.join(exceptions, "path", "left").filter("skip IS NULL OR NOT (skip OR spanning)")
        if whole:
            placed = placed.unionByName(spanned.drop(_CORRUPT).join(exceptions, "path").filter("NOT skip"))
        placed = placed.withColumn("layout", F.coalesce("layout", F.lit(0)))
    present = _present([name for names in layouts.values() for name in names])
    named = placed.select(*_named(present, layouts, F.col("layout")))
    return DeliverySource(type_columns(named), account)


def _unescaped(path: str) -> str:
    """A path as the reader takes it, from the percent-encoded form of the metadata column; glob
    signs are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.csv$", "").alias("stem")


def _present(names: list[str]) -> list[str]:
    """Known columns in their order, then further ones by name.

    Column names are compared without case downstream, so of names that differ only in case the
    known, or else the first, one is kept.
    """
    known = [name for name in DELIVERY_COLUMNS if name in names]
    taken = {name.lower() for name in DELIVERY_COLUMNS} | {""}
    extra = []
    for name in sorted(set(names)):
        if name.lower() not in taken:
            taken.add(name.lower())
            extra.append(name)
    return known + extra


def _named(present: list[str], layouts: dict[int, list[str]], layout: Column) -> list[Column]:
    """Pick each named column from the position it has in the row's layout."""
    columns = []
    for name in present:
        picked = None
        for number, names in layouts.items():
            if name in names:
                source = F.col(f"_c{names.index(name)}")
                picked = (F.when if picked is None else picked.when)(layout == number, source)
        columns.append(picked.alias(name))
    return columns


def type_columns(rows: DataFrame) -> DataFrame:
    """Text columns to the typed layout; absent columns take their default."""

    def typed(name):
        there = name in rows.columns
        if name in NUMERIC_COLUMNS:
            value = number_or_zero(name) if there else "0D"
        elif name in BLANK_COLUMNS:
            value = f"coalesce({name}, '')" if there else "''"
        elif name == "innings":
            value = whole_number(name) if there else "CAST(NULL AS INT)"
        else:
            value = name if there else "CAST(NULL AS STRING)"
        return f"{value} AS {name}"

    extra = [
        "`" + name.replace("`", "``") + "`" for name in rows.columns if name not in DELIVERY_COLUMNS
    ]
    return rows.selectExpr(*[typed(name) for name in DELIVERY_COLUMNS], *extra)
