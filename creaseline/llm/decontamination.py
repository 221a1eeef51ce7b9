"""Benchmark passages in documents, by a prefix-filtered join.

A window is ten consecutive words of an item, or the whole of a shorter item. Its words are ordered
by rarity, counted over all documents; a document that contains the window must contain the rarest
one, so this word alone (the window's necessary prefix) is joined. Where it meets a document, its
offset in the window gives the only place the window can have; the place must lie inside the
document (length and position bounds), and the words there are compared one by one.

Both passes over the documents are joins with a broadcast side of at most `BROADCAST_ROWS` rows. A
larger side is cut by hash into parts of that size, one pass over the documents for each.

Defined cases: a null text has no words; an item without words has no window; repeated items share
their windows; an empty benchmark contaminates nothing; an empty table gives an empty table;
repeated rows, also of one key with other texts, are judged each; null keys are keys.
"""

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.sources.storage import written

WINDOW = 10
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The words of a text, not yet lower-cased."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case; other letters keep their case, which `lower` would change."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(window, item, tokens): one row for each item and different window."""
    split = benchmark.select(F.col(item).alias("item"), F.transform(words(F.col(text)), lowered).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - WINDOW + 1, F.lit(1)))
    cut = split.select("item", "all", F.explode(starts).alias("at"))
    cut = cut.select("item", F.slice("all", F.col("at"), F.least(F.size("all"), F.lit(WINDOW))).alias("tokens"))
    return cut.select(F.md5(F.concat_ws(" ", "tokens").cast("binary")).alias("window"), "item", "tokens").distinct()


def _parts(side: DataFrame, key: str) -> Iterator[DataFrame]:
    """The rows of a small side in parts that may be broadcast."""
    n = math.ceil(side.count() / (BROADCAST_ROWS / 2))
    for part in range(n):
        yield F.broadcast(side.filter(F.pmod(F.xxhash64(key), F.lit(n)) == part) if n > 2 else side)
        if n <= 2:
            return


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def _rarity(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, uses): how often each token stands in all texts."""
    # An outer explode: the plain one would infer filters that split every text again.
    spoken = texts.select(F.explode_outer("words").alias("word")).select(lowered(F.col("word")).alias("token"))
    spoken = spoken.withColumn("hash", F.xxhash64("token"))
    wanted = tokens.withColumn("hash", F.xxhash64("token")).withColumnRenamed("token", "wanted")
    met = [spoken.join(part, "hash").filter("token = wanted").groupBy("token").count() for part in _parts(wanted, "hash")]
    empty = texts.select(F.lit("").alias("token"), F.lit(0).cast("bigint").alias("count")).limit(0)
    return _union(met or [empty]).select("token", F.col("count").alias("uses"))


def index(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per window: the hash of its rarest token, that token's offset, its length and text."""
    different = windows.select("window", "tokens").distinct()
    tokens = written(different.select(F.explode("tokens").alias("token")).distinct(), "benchmark-tokens")
    uses = written(_rarity(texts, tokens), "benchmark-rarity")
    spread = different.select("window", F.posexplode("tokens").alias("offset", "token")).join(uses, "token", "left")
    rarest = spread.groupBy("window").agg(
        F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token", "offset")).alias("prefix")
    )
    # A window with a word that no document has cannot occur.
    return different.join(rarest.filter("prefix.uses > 0"), "window").select(
        "window", F.size("tokens").alias("length"), F.concat_ws(" ", "tokens").alias("passage"),
        F.xxhash64("prefix.token").alias("hash"), F.col("prefix.offset").alias("offset"),
    )


def occurrences(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """(id, digest, window, start, length) for each place where a window of the index stands."""
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), words(F.col(text)).alias("words"))
    spread = texts.select("id", "digest", "words", F.posexplode_outer("words").alias("at", "word"))
    spread = spread.select("id", "digest", "words", "at", F.xxhash64(lowered(F.col("word"))).alias("hash"))
    start = F.col("at") - F.col("offset")
    # Words hold no blank, so the joined words are equal only if each one is. Without lambdas the
    # join stays in generated code, and no row carries its document's words beyond it.
    place = F.array_join(F.slice("words", start + 1, F.col("length")), " ")
    met = [
        spread.join(part, "hash")
        .filter((start >= 0) & (start + F.col("length") <= F.size("words")) & (lowered(place) == F.col("passage")))
        .select("id", "digest", "window", start.alias("start"), "length")
        for part in _parts(found, "hash")
    ]
    empty = texts.select("id", "digest", F.lit("").alias("window"), F.lit(0).alias("start"), F.lit(0).alias("length")).limit(0)
    return _union(met or [empty]).distinct()


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items (as text, sorted) and contaminated."""
    each = written(windows(benchmark, item, item_text), "benchmark-windows")
    texts = docs.select(words(F.col(text)).alias("words"))
    found = written(index(each, texts), "benchmark-index")
    hits = written(occurrences(docs, key, text, found), "benchmark-hits")
    same = ["id", "digest"]
    covered = (
        hits.select(*same, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
        .distinct().groupBy(*same).agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = (
        hits.select(*same, "window").distinct().join(each.select("window", "item"), "window")
        .groupBy(*same).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    judged = covered.join(items, (covered.id.eqNullSafe(items.id)) & (covered.digest == items.digest)).select(
        covered.id.alias("hit_id"), covered.digest.alias("hit_digest"), "n_hit", "items"
    )
    counted = docs.select(
        F.col(key).alias("id"), F.xxhash64(text).alias("digest"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"),
    )
    out = counted.join(judged, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left")
    nothing = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(F.coalesce("items", nothing)).cast("bigint").alias("n_items"),
        F.coalesce("items", nothing).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no window stands."""
    each = written(windows(benchmark, "item_id", "text"), "benchmark-windows")
    found = written(index(each, docs.select(words(F.col(text)).alias("words"))), "benchmark-index")
    hits = occurrences(docs, key, text, found).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    hits = written(hits.distinct(), "benchmark-hits")
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__digest"))
    return docs.join(hits, same, "left_anti")
