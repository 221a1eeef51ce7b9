"""Shards of bounded size by extendible hashing.

A row's key is hashed to 60 bits. A shard is a prefix of these bits: the directory starts with the
empty prefix, and only a prefix whose rows are larger than the limit is split on its next bit, until
every shard fits. So shards have different depths, and a row's shard is its shortest prefix whose
bytes are within the limit.

Bytes are summed by prefixes of one depth, a few bits deeper than the average shard needs (one
partial sum per task and prefix, whatever the skew), and the sums of all shorter prefixes come from
these. Prefixes still too large there are split in a further round over their rows alone. Rows that
share all 60 bits, such as repeated keys, are split on the bits of a row number's hash instead.

Defined cases: a null key hashes as an empty string; a null text has 0 bytes; an empty table gives
an empty table; repeated rows are placed each; a single row larger than the limit ends alone in a
shard of full depth, which is the only kind of shard beyond the limit.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.sources.storage import written

BITS = 60
_EXTRA = 4  # bits deeper than the average shard
_ROUND = 16  # bits that each further round looks ahead
_HASH, _BYTES, _CELL = "__hash", "__bytes", "__cell"


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(depth) -> Column:
    return F.expr(f"shiftright({_HASH}, {BITS} - {depth})")


def directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each prefix of `high` bits: the depth and prefix of its shard, null if none fits yet."""
    cells = rows.groupBy(_prefix(high).alias(_CELL)).agg(
        F.sum(_BYTES).alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    cells = written(cells, "shard-cells")
    levels = cells.select(
        F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), _CELL, "bytes", "rows"
    ).withColumn("prefix", F.expr(f"shiftright({_CELL}, {high} - depth)"))
    fitting = levels.groupBy("depth", "prefix").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")
    ).filter(F.col("shard_bytes") <= limit)
    shortest = levels.select(_CELL, "depth", "prefix").join(fitting, ["depth", "prefix"]).groupBy(_CELL).agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("shard")
    )
    return cells.select(_CELL).join(shortest, _CELL, "left").select(_CELL, "shard.*")


def _place(rows: DataFrame, limit: int, bits_before: int, repeats: bool) -> DataFrame:
    total = rows.agg(F.coalesce(F.sum(_BYTES), F.lit(0))).first()[0]
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(max(total, 1) / limit)) + _EXTRA))
    placed, names = [], [*rows.columns, "depth", "prefix", "shard_bytes", "shard_rows"]
    while True:
        found = written(directory(rows, low, high, limit), "shard-directory")
        joined = rows.withColumn(_CELL, _prefix(high)).join(found, _CELL)
        placed.append(joined.filter("depth IS NOT NULL").select(*names))
        if found.filter("depth IS NULL").isEmpty():
            break
        rows = written(joined.filter("depth IS NULL").select(*rows.columns), "shard-oversized")
        if high == BITS:
            placed.append(_same_hash(rows, limit, names, repeats))
            break
        low, high = high + 1, min(BITS, high + _ROUND)
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out.withColumn("depth", F.col("depth") + bits_before)


def _same_hash(rows: DataFrame, limit: int, names: list[str], repeats: bool) -> DataFrame:
    """Rows alone with their hash keep it; others are split on the hash of a row number."""
    if repeats:
        return rows.select("*", F.lit(BITS).alias("depth"), F.col(_HASH).alias("prefix"), F.col(_BYTES).alias("shard_bytes"), F.lit(1).cast("bigint").alias("shard_rows")).select(*names)
    numbered = written(rows.withColumn("__first", F.col(_HASH)).withColumn("__row", F.monotonically_increasing_id()), "shard-repeats")
    renamed = numbered.withColumn(_HASH, hash_bits(F.concat_ws("/", "__first", "__row"))).drop("__row")
    return _place(renamed, limit, BITS, True).select(*names)


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the text, with n_bytes and the shard: depth, prefix, shard_bytes, shard_rows.

    Depths above 60 belong to repeated keys; their prefix counts bits of the second hash. Columns
    of the input called like a new column are replaced.
    """
    new = ["n_bytes", "depth", "prefix", "shard_bytes", "shard_rows"]
    keep = [c for c in docs.columns if c not in (*new, text)]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        hash_bits(F.col(f"`{key}`")).alias(_HASH),
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias(_BYTES),
    )
    placed = _place(rows, limit, 0, False)
    return placed.select(*[f"`{c}`" for c in keep], F.col(_BYTES).alias("n_bytes"), *new[1:])


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the rows as one folder per shard below `path`. Keys must be unique here."""
    shards = assign(docs.select(key, text), limit, key, text).select(
        key, F.concat_ws("-", "depth", "prefix").alias("shard")
    )
    docs.join(shards, key).repartition("shard").write.partitionBy("shard").parquet(path)
