"""Fuzzy deduplication of lines across documents.

A line is what stands between line feeds, without blanks at its ends; blank lines are left alone.
Lines are similar if their sets of five-character shingles (UTF-16 units; a shorter line is one
shingle) have a Jaccard similarity of at least 0.8. One line stays of each component of similar
lines: the first one, by key and then by line number.

1. Equal lines become one row with a count before anything is compared.
2. A signature of each different line is drawn from the hashes of its different shingles. The hash range
   is cut into bins, and the least hash of each bin is the signature (one-permutation MinHash); all bits
   set stand in for an empty bin. A bin agrees with a chance of at least the similarity, so lines at the
   threshold share one band with a chance of 99.9 percent, by either of two families: 18 bands of five
   bins for lines of 128 shingles and more, 14 bands of four bins below. The short lines' bins are drawn
   from two further hashes of each shingle, 28 from each, or most would be empty and one frequent shingle
   would make a bucket. Lines less than a quarter above 128 are in both families, so that no similar
   lines are apart.
3. A band's bucket is cut, in the order of sizes, wherever two sizes leave no room for the threshold; no
   similar pair is parted, and lines left alone go. Within a bucket each line is first compared with the
   most frequent one: of a group of copies with changes the original, which is near all of them though
   they are not near each other. The links found give first components. Then all pairs of lines of a
   bucket that are not yet in one component are compared, whatever the size of the bucket. Before a text
   is fetched, exact bounds drop pairs that cannot be similar: by the numbers of different shingles, and
   by 1,152 parities that each line's different shingles flip; parities count what two lines do not share,
   so long lines do not fill them. Lines of a large bucket meet in classes of sizes and in blocks, so hot
   buckets spread.
4. Candidates are verified by the exact Jaccard similarity of their shingle sets, and the links left
   go through star contraction.

Everything is made of DataFrame functions. What is wide is shuffled in parts, one after the other, each
stored before the next begins, so that the disk holds the shuffle of one part: lines by their hash, bands
by their number, buckets and pairs by as many rows as there are different lines.

Defined cases: a null text has no lines and stays null; an empty table gives an empty table; rows
that share a key count as one document, so repeated rows are decided alike; a null key comes last;
a document may lose all of its lines, and then has an empty text.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creaseline.llm.components import components
from creaseline.sources.storage import forget, written_alone

SHINGLE = 5
SIMILARITY = 0.8
LONG = 128  # different shingles of a line whose bins are drawn once
LONG_BANDS, LONG_BAND = 18, 5  # bands, and bins of a band
SHORT_BANDS, SHORT_BAND = 14, 4  # half of them from one further hash of each shingle, half from another
BANDS = LONG_BANDS + SHORT_BANDS
PARTS = 2  # parts of the lines, by hash, that are shuffled one after the other
PASSES = 4  # parts of the bands that are shuffled one after the other
BLOCK = 2048  # lines of one class of sizes in a large bucket that one join key brings together
BROADCAST_ROWS = 1_000_000  # line hashes (8 bytes) that may be broadcast; more are joined by shuffle
_LONG_BINS, _SHORT_BINS = LONG_BANDS * LONG_BAND, SHORT_BANDS * SHORT_BAND
_HASHES = (1 << 58) - 1  # a line's hash has 58 bits, which leaves room for its frequency above them
_LANES, _BITS = LONG_BAND, 12  # bins of a band in one number, bits of each; all set in an empty bin
_EMPTY = (1 << (_LANES * _BITS)) - 1  # a band of empty bins
SHARES = LONG_BANDS  # numbers of 64 marks; each has an equal share of the hash range


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, at, line) of every line that is not blank."""
    # An outer explode: the plain one would infer filters that split every text again.
    spread = docs.select(F.col(key).alias("id"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("at", "line"))
    return spread.select("id", "at", F.trim("line").alias("line")).filter("line <> ''")


def _hash(line: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(line), 6)


def _part(frame: DataFrame, key: Column, part: int, parts: int) -> DataFrame:
    return frame if parts == 1 else frame.filter(F.pmod(key, F.lit(parts)) == part)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _rounds(rows: DataFrame, most: int | None) -> int:
    """Parts of at most about `most` rows."""
    return 1 if most is None else max(1, math.ceil(rows.count() / max(1, most)))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _shingles(units: Column, make) -> Column:
    """`make` of each shingle of a UTF-16 column."""
    last = F.greatest(F.floor(F.octet_length(units) / 2).cast("int") - SHINGLE, F.lit(0))
    return F.transform(
        F.sequence(F.lit(1), 2 * last + 1, F.lit(2)), lambda i: make(F.substr(units, i, F.lit(2 * SHINGLE)))
    )


def _seeded(seed: int):
    return lambda own: F.xxhash64(own, F.lit(seed))


def signed(lines: DataFrame) -> DataFrame:
    """One row per different line: hash, rank (frequency, then hash), size (different shingles), bands, marks.

    `bands` holds a number of 32 bits for 12 bits of the least hash of each of a band's bins; a band of
    empty bins, and those of the family that a line has no part in, are null. `marks` are 1,152 parities: each different shingle flips
    one, in the number of its share of the hash range, so that two lines differ in at least as many
    shingles as in marks, however long they are.

    Shingles are rows; all rows of a line are in one task, so the shuffle carries lines only.
    """
    told = lines.select(_hash(F.col("line")).alias("hash"), "line").repartition("hash")
    equal = told.groupBy("hash", "line").agg(F.count(F.lit(1)).alias("n")).withColumn("units", F.encode("line", "UTF-16BE"))
    often = F.shiftleft(F.least(F.floor(F.log2("n")), F.lit(31)).cast("bigint"), 58)
    rank = often.bitwiseOR(F.col("hash")).alias("rank")
    sized = equal.select("hash", rank, F.array_distinct(_shingles(F.col("units"), lambda s: F.xxhash64(s))).alias("own"))
    sized = sized.select("hash", "rank", F.size("own").alias("size"), "own")
    again = [F.transform("own", _seeded(seed)) for seed in (1, 2)]
    drawn = F.when(F.col("size") < LONG / SIMILARITY, F.concat("own", *again)).otherwise(F.col("own"))
    # Drawn before the explode, which is compiled only without functions of arrays; an outer explode, as the
    # plain one would infer filters that hash every shingle again.
    rows = sized.select("hash", "rank", "size", drawn.alias("own")).select("hash", "rank", "size", F.posexplode_outer("own").alias("at", "own"))
    # Bins cut the range of 64-bit hashes evenly.
    place = F.shiftright("own", 32) + F.lit(1 << 31)
    first = F.col("at") < F.col("size")
    bin_ = F.shiftright(place * F.when(first, F.lit(_LONG_BINS)).otherwise(F.lit(_SHORT_BINS // 2)), 32).cast("int")
    rows = rows.withColumn("first", first).withColumn("bin", bin_).select(
        "hash", "rank", "size", "own", "first",
        F.expr(f"IF(first, bin div {LONG_BAND}, {LONG_BANDS} + IF(at < 2 * size, 0, {SHORT_BANDS // 2}) + bin div {SHORT_BAND})")
        .cast("int").alias("band"),
        F.expr(f"bin % IF(first, {LONG_BAND}, {SHORT_BAND})").alias("lane"),
    )
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("own").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    banded = rows.groupBy("hash", "rank", "size", "band").agg(
        *[F.min(F.when(F.col("lane") == k, F.col("own"))).alias(f"least_{k}") for k in range(_LANES)],
        F.bit_xor(F.when(F.col("first"), mark)).alias("mark"),
    )
    lanes = [
        F.shiftleft(F.coalesce(F.col(f"least_{k}"), F.lit(-1)).bitwiseAND(F.lit((1 << _BITS) - 1).cast("bigint")), _BITS * k)
        for k in range(_LANES)
    ]
    banded = banded.select("hash", "rank", "size", "band", "mark", reduce(Column.bitwiseOR, lanes).alias("value"))
    asked = F.when(F.col("band") >= LONG_BANDS, True).otherwise(F.col("size") >= LONG)
    values = [F.max(F.when((F.col("band") == b) & asked, F.col("value"))).alias(f"band_{b}") for b in range(BANDS)]
    marks = [F.max(F.when(F.col("band") == s, F.col("mark"))).alias(f"mark_{s}") for s in range(SHARES)]
    whole = banded.groupBy("hash", "rank", "size").agg(*values, *marks)
    return whole.select(
        "hash", "rank", "size",
        F.array(*[F.when(F.col(f"band_{b}") != _EMPTY, F.hash(f"band_{b}")) for b in range(BANDS)]).alias("bands"),
        F.array(*[F.coalesce(f"mark_{s}", F.lit(0).cast("bigint")) for s in range(SHARES)]).alias("marks"),
    )


def members(signatures: DataFrame) -> DataFrame:
    """(band, hash, pivot, size, fits, n): different lines of each bucket with several; the pivot is the most frequent.

    Lines of a bucket whose sizes are next to each other leave room for the threshold; `fits` tells
    whether those of line and pivot do, `n` how many lines the bucket has.
    """
    return _all([written_alone(_shared(signatures, range(p, BANDS, PASSES)), "line-members") for p in range(PASSES)])


def _shared(signatures: DataFrame, bands: range) -> DataFrame:
    """`members` of some of the bands."""
    values = F.array(*[F.col("bands")[b] for b in bands])
    spread = signatures.select("rank", "size", F.posexplode(values).alias("at", "value")).filter("value IS NOT NULL")
    # One shuffle serves the aggregate and the join, as both need all columns.
    spread = spread.select(F.xxhash64(F.col("at") * PASSES + bands.start, "value").alias("band"), "rank", "size").repartition("band")
    several = spread.groupBy("band").agg(
        F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n")
    ).filter((F.col("low") != F.col("high")) & ((F.col("n") > 2) | _sizes_fit("least", "most")))
    by_size = Window.partitionBy("band").orderBy("size", "rank")
    found = spread.join(several.select("band"), "band").withColumn("before", F.lag("size").over(by_size))
    found = found.withColumn("run", F.count(F.when(~_sizes_fit("before", "size"), 1)).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    bucket = Window.partitionBy("band", "run")
    found = found.select(
        "band", "run", "rank", "size", F.min("rank").over(bucket).alias("low"), F.count(F.lit(1)).over(bucket).cast("int").alias("n"),
        F.max(F.struct("rank", "size")).over(bucket).alias("most"),
    ).filter("low <> most.rank")
    bare = {c: F.col(c).bitwiseAND(F.lit(_HASHES)) for c in ("rank", "most.rank")}
    return found.select(
        F.xxhash64("band", "run").alias("band"), bare["rank"].alias("hash"), bare["most.rank"].alias("pivot"), "size",
        _sizes_fit("size", "most.size").alias("fits"), "n",
    )


def unlinked_pairs(found: DataFrame, tied: DataFrame, facts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of hashes that share a bucket but no component of `tied`, save those with the pivot.

    With `facts` (hash, size, marks) only pairs that can reach the threshold: bounds on sizes and
    differences are tested before a pair leaves the join. Lines of a bucket with more than `BLOCK` meet
    only lines of their own or the next class of sizes, and in blocks. At most about `most` rows get
    their marks at a time.
    """
    known = tied.select(F.col("node").alias("hash"), "component")
    size = F.col("size") if "size" in found.columns else F.lit(1)
    named = found.filter("hash <> pivot").select("band", "hash", size.alias("size")).join(known, "hash", "left")
    named = named.withColumn("component", F.coalesce("component", "hash")).repartition("band")
    bucket = Window.partitionBy("band")
    # Sizes of a similar pair differ by a factor of 1 / SIMILARITY at most.
    class_ = F.floor(F.log("size") / math.log(1 / SIMILARITY)).cast("int")
    named = named.select(
        "band", "hash", "component", class_.alias("class"), F.count(F.lit(1)).over(bucket).alias("n"),
        *[f("component").over(bucket).alias(c) for c, f in (("low", F.min), ("high", F.max))],
    ).filter("low <> high").drop("low", "high")
    named = written_alone(named, "line-classes")
    keyed = written_alone(_meetings(named), "line-meetings")
    rounds = _rounds(keyed, most)
    pairs = [written_alone(_met(_part(keyed, F.col("band"), r, rounds), facts), "line-pairs") for r in range(rounds)]
    forget(named, keyed)
    return _all(pairs).distinct()


def _meetings(named: DataFrame) -> DataFrame:
    """(band, class, block, hash, component, role): where lines of a bucket meet.

    Roles are bits: 1 for a host, 2 for a visitor, 4 for a visitor from the class above.
    """
    few = named.filter(F.col("n") <= BLOCK).select("band", F.lit(0).alias("class"), F.lit(0).alias("block"), "hash", "component", F.lit(3).alias("role"))
    many = named.filter(F.col("n") > BLOCK).drop("n")
    sizes = many.groupBy("band", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    hosts = many.join(sizes, ["band", "class"]).select(
        "band", "class", F.pmod(F.xxhash64("hash"), "blocks").cast("int").alias("block"), "hash", "component", F.lit(1).alias("role")
    )
    visits = many.select("band", "hash", "component", F.posexplode(F.array("class", F.col("class") - 1)).alias("above", "class"))
    visits = visits.join(sizes, ["band", "class"]).select(
        "band", "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "hash", "component", (F.col("above") * 4 + 2).alias("role")
    )
    return _all([few, hosts, visits])


def _met(keyed: DataFrame, facts: DataFrame | None) -> DataFrame:
    """Distinct pairs (a, b) of `_meetings` that can reach the threshold by `facts`."""
    if facts is None:
        named = keyed.withColumns({"size": F.lit(1), "marks": F.array(*[F.lit(0).cast("bigint")] * SHARES)})
    else:
        named = keyed.join(facts, "hash")
    key = ["band", "class", "block"]
    # One shuffle serves both sides, as long as they have the same columns and no filter of their own.
    named = named.repartition(*key)
    side = [named.select(*key, *[F.col(c).alias(f"{c}_{x}") for c in ("hash", "component", "size", "marks", "role")]) for x in "ab"]
    roles = F.col("role_a").bitwiseAND(1) * F.col("role_b").bitwiseAND(2) == 2
    once = (F.col("role_b").bitwiseAND(4) + F.col("role_a").bitwiseAND(0) == 4) | (F.col("hash_a") < F.col("hash_b"))
    met = side[0].join(side[1], key).filter((F.col("component_a") != F.col("component_b")) & roles & once & _possible())
    return met.select(F.least("hash_a", "hash_b").alias("a"), F.greatest("hash_a", "hash_b").alias("b")).distinct()


def _possible() -> Column:
    """Whether sizes and marks of a pair leave room for the threshold; never false for a similar pair.

    Of a similar pair, at most (1 - s) / (1 + s) of both sizes are shingles that only one line has: a
    ninth at 0.8.
    """
    apart = reduce(Column.__add__, [F.bit_count(F.col("marks_a")[q].bitwiseXOR(F.col("marks_b")[q])) for q in range(SHARES)])
    room = apart * 9 <= F.col("size_a") + F.col("size_b")
    return _sizes_fit("size_a", "size_b") & room


def _sizes_fit(a: str, b: str) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def links(lines: DataFrame) -> DataFrame:
    """(a, b): digests of different lines whose similarity reaches the threshold; they span the components."""
    own = _hash(F.col("line"))
    signatures = [written_alone(signed(_part(lines, own, p, PARTS)), "line-signatures") for p in range(PARTS)]
    most = sum(part.count() for part in signatures)
    found = members(_all(signatures))
    facts = []
    for p, part in enumerate(signatures):
        asked = _part(found, F.col("hash"), p, PARTS).select("hash").distinct()
        facts.append(written_alone(part.join(asked, "hash", "left_semi").select("hash", "size", "marks"), "line-facts"))
        forget(part)
    facts = _all(facts)
    near = _verified(lines, _pivot_pairs(found, facts, most), most)
    tied = components(near)
    rest = _verified(lines, unlinked_pairs(found.filter("n > 2"), tied, facts, most), most)
    forget(found, facts, tied)
    return near.union(rest).select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"))


def _pivot_pairs(found: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of a bucket's pivot and another line of it that can reach the threshold; `most` get their marks at a time."""
    first = found.filter("fits AND hash <> pivot").select(F.col("pivot").alias("a"), F.col("hash").alias("b")).distinct()
    first = written_alone(first, "line-pivots")
    rounds, pairs = _rounds(first, most), []
    for r in range(rounds):
        part = _part(first, F.xxhash64("a", "b"), r, rounds)
        for x in "ab":
            part = part.join(facts.select(F.col("hash").alias(x), F.col("size").alias(f"size_{x}"), F.col("marks").alias(f"marks_{x}")), x)
        pairs.append(written_alone(part.filter(_possible()).select("a", "b"), "line-pairs"))
    forget(first)
    return _all(pairs)


def _verified(lines: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, digest_a, digest_b) of the pairs of hashes whose similarity reaches the threshold.

    At most about `most` pairs get their texts at a time.
    """
    stored, pairs = pairs, written_alone(pairs, "line-candidates")
    forget(stored)
    asked = pairs.select(F.col("a").alias("hash")).union(pairs.select(F.col("b").alias("hash"))).distinct()
    asked = written_alone(asked, "line-asked")
    few = asked.count() <= BROADCAST_ROWS
    named = lines.select(_hash(F.col("line")).alias("hash"), "line")
    parts = 1 if few else PARTS
    texts = []
    for p in range(parts):
        some = _part(asked, F.col("hash"), p, parts)
        held = _part(named, F.col("hash"), p, parts).join(F.broadcast(some) if few else some, "hash", "left_semi")
        texts.append(written_alone(held.distinct(), "line-texts"))
    texts = _all(texts)
    one = texts.select(F.col("hash").alias("a"), F.col("line").alias("line_a"))
    two = texts.select(F.col("hash").alias("b"), F.col("line").alias("line_b"))
    rounds, near = _rounds(pairs, most), []
    for r in range(rounds):
        both = _part(pairs, F.xxhash64("a", "b"), r, rounds).join(one, "a").join(two, "b")
        # Sets of hashes are quick to compare and hardly ever let a pair through that the shingles
        # themselves, compared next, do not.
        close = _similar(both, lambda s: F.xxhash64(s))
        links_ = _similar(close, F.hex).select("a", "b", *[_digest(F.col(f"line_{x}")).alias(f"digest_{x}") for x in "ab"])
        near.append(written_alone(links_, "line-links"))
    forget(pairs, asked, texts)
    return _all(near)


def _similar(pairs: DataFrame, make) -> DataFrame:
    """The pairs whose sets of `make` of each shingle are similar enough.

    Encoded lines and sets are bound to lambda variables, so that each is made once although it is
    used often, and only lines are shuffled.
    """
    def enough(sizes):
        return sizes["s"] >= SIMILARITY * (sizes["a"] + sizes["b"] - sizes["s"])

    def compared(sets):
        shared = F.size(F.array_intersect(sets["a"], sets["b"]))
        sizes = F.struct(F.size(sets["a"]).alias("a"), F.size(sets["b"]).alias("b"), shared.alias("s"))
        return F.exists(F.array(sizes), enough)

    def sets(units):
        return F.struct(*[F.array_distinct(_shingles(units[x], make)).alias(x) for x in "ab"])

    units = F.struct(*[F.encode(f"line_{x}", "UTF-16BE").alias(x) for x in "ab"])
    return pairs.filter(F.exists(F.array(units), lambda u: F.exists(F.array(sets(u)), compared)))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, at) of every line that is not the first of its component."""
    lines = _lines(docs, key, text)
    tied = written_alone(components(links(lines)), "tied-lines")
    marked = lines.select("id", "at", _digest(F.col("line")).alias("digest"))
    firsts = marked.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    known = written_alone(
        firsts.join(tied, firsts.digest == tied.node, "left").filter("n > 1 OR component IS NOT NULL")
        .select("digest", "first", F.coalesce("component", "digest").alias("component")),
        "repeated-lines",
    )
    best = known.groupBy("component").agg(F.min("first").alias("best"))
    named = written_alone(known.join(best, "component").select("digest", "best"), "line-firsts")
    return marked.join(named, "digest").filter(
        ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("at") == F.col("best.at")))
    ).select("id", "at")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_lines (not blank) and the sorted numbers, from 0, of its removed lines."""
    removed = removed_lines(docs, key, text).groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("at"))
    counted = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.expr(f"size(filter(split(`{text}`, '\n'), l -> trim(l) <> ''))"), F.lit(0)).alias("n"),
    )
    nothing = F.array().cast("array<int>")
    return counted.join(removed, F.col("key").eqNullSafe(F.col("id")), "left").select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_lines"), F.coalesce("at", nothing).alias("removed")
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """`docs` with removed lines taken out of the text and `n_chars`, if there, counted again."""
    removed = removed_lines(docs, key, text).groupBy("id").agg(F.collect_set("at").alias("__removed"))
    joined = docs.join(removed.withColumnRenamed("id", "__id"), F.col(key).eqNullSafe(F.col("__id")), "left")
    cut = F.expr(
        f"IF(__removed IS NULL, `{text}`, array_join(filter(split(`{text}`, '\n'), (l, i) -> NOT array_contains(__removed, i)), '\n'))"
    )
    out = joined.withColumn(text, cut)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
