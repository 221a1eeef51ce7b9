"""Compressed vectors: codebooks for equal parts of a vector, learned by ball k-means in integers.

Each component becomes a scaled integer, each vector is cut into equal parts, and each part position
has a codebook of at most 256 entries. Rounds of assignment and replacement by the mean are exact:
all sums are of integers, so neither the order of rows nor their partitions matter.

A round uses what the round before knows. The parts that an entry holds lie in a ball around it: its
radius is the largest distance of a part to the entry before it moved, plus the move. An entry nearer
than twice the radius is a neighbour. A part can only change to a neighbour that is no further from
its own entry than twice its own distance, so sorted neighbours cut the ball into rings: in the
innermost, the stable core, no distance but the own one is computed, and in every other ring only
the neighbours up to that ring are candidates. Parts that stay also leave the sums alone: tasks
return changes of sums and counts, one row for each entry and component, and the driver adds them to
codebooks of bounded size.

The state (id, label, components, code) is written after every assignment, and the one before is
deleted then, so a lost executor costs a re-read.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped;
so are vectors of another length than the commonest (of equally common ones the shortest); a length
that does not divide into the parts is filled up with zeros; fewer rows than entries give a smaller
codebook; equal ids are rows of their own, taken by id and then by vector, a null id last; an empty
table gives an empty table. Components beyond 2^24 after scaling are an error, as distances would not
fit. Other columns of the table do not matter, whatever their names.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.sources.storage import discard, scratch_path, written

PARTS = 4
ENTRIES = 256  # a code is one byte
ROUNDS = 4
SCALE = 1024
BROADCAST_ROWS = 1_000_000  # labels (a key and 8 bytes) that may be broadcast; more are joined by shuffle
SALTS = 16
_MOST = 1 << 24
_ROWS = 1 << 16  # vectors handled at once
_COUNT, _RADIUS = -1, -2  # positions of an entry's count and radius among those of its components


@dataclass
class Codebooks:
    """Entries by part, entry and component; integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers in which squared distances are exact: doubles while these are below 2^53."""
    most = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    kind = np.float64 if 4 * a.shape[1] * most * most < 1 << 53 else np.int64
    return a.astype(kind), b.astype(kind)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the row beside it."""
    apart = points.astype(np.int64) - entries
    return np.einsum("ij,ij->i", apart, apart)


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point, the first of several."""
    points, entries = _exact(points, entries)
    lengths = (entries * entries).sum(axis=1)
    out = np.empty(len(points), dtype=np.int64)
    for start in range(0, len(points), 8192):
        out[start : start + 8192] = np.argmin(lengths - 2 * (points[start : start + 8192] @ entries.T), axis=1)
    return out


class Balls:
    """The neighbours of each entry of a codebook, nearest first, with their squared distances."""

    def __init__(self, entries: np.ndarray, radii: np.ndarray):
        self.entries = entries
        self.order, self.apart = [], []
        for i, entry in enumerate(entries):
            d = squared(entries, entry)
            near = np.flatnonzero(np.sqrt(d) <= 2 * radii[i] * (1 + 1e-12) + 1e-6)
            near = near[near != i]
            near = near[np.argsort(d[near], kind="stable")]
            self.order.append(near)
            self.apart.append(d[near])

    def assign(self, points: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The nearest entry of each point, the first of several, given its entry of the last round."""
        result = own.copy()
        far = 4 * squared(points, self.entries[own])
        by_entry = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[by_entry], np.arange(len(self.entries) + 1))
        for i, (start, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if start == stop or not len(self.order[i]):
                continue
            members = by_entry[start:stop]
            ring = np.searchsorted(self.apart[i], far[members], side="right")
            reach = 1
            while True:  # rings are taken together in widths that double
                inside = members[(ring > reach >> 1) & (ring <= reach)]
                if len(inside):
                    candidates = np.sort(np.append(self.order[i][:reach], i))
                    result[inside] = candidates[nearest(points[inside], self.entries[candidates])]
                if reach >= len(self.order[i]):
                    break
                reach *= 2
        return result


def components(vectors: DataFrame, key: str, vector: str, label: str | None, scale: int = SCALE) -> DataFrame:
    """(id, label, point) of the rows that take part; point has integer components."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(
        F.col(key).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), x.alias("vector")
    )
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(finite)
    fits = F.forall("vector", lambda v: F.abs(v) < float(_MOST) / scale)
    checked = F.when(fits, F.col("vector")).otherwise(F.raise_error(F.lit("a component is too large to be coded")))
    rows = rows.select("id", "label", checked.alias("vector"))
    return rows.select("id", "label", F.transform("vector", lambda v: F.floor(v * scale).cast("int")).alias("point"))


def _points(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("point")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _gathered(batches, most: int):
    """Batches put together, so that every group of rows has about `most`."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _assigned(state: DataFrame, books: np.ndarray, radii: np.ndarray | None) -> DataFrame:
    """`state` with its codes under `books`, the codes before, and squared distances to the own entries.

    `radii`: by part and entry, known from the round before; None if there was none.
    """
    parts, _, width = books.shape

    def run(batches):
        balls = [Balls(b, r) for b, r in zip(books, radii)] if radii is not None else None
        for batch in _gathered(batches, _ROWS):
            points, n = _points(batch, parts * width), batch.num_rows
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts).astype(np.int64)
            code, near = np.empty((n, parts), dtype=np.int64), np.empty((n, parts), dtype=np.int64)
            for p in range(parts):
                own = points[:, p * width : (p + 1) * width]
                code[:, p] = balls[p].assign(own, old[:, p]) if balls else nearest(own, books[p])
                near[:, p] = squared(own, books[p][code[:, p]])
            packed = code.astype(np.uint8)
            codes = pa.array([row.tobytes() for row in packed], pa.binary())
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            near_ = pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))
            before = batch.column("code")
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("point"), codes, before, near_],
                ["id", "label", "point", "code", "before", "near"],
            )
            yield from (out.slice(at, 8192) for at in range(0, n, 8192))

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, point array<int>, code binary, before binary, near array<long>"
    return state.select("id", "label", "point", "code").mapInArrow(run, schema)


def _changes(state: DataFrame, parts: int, entries: int, width: int, first: bool) -> dict[tuple[int, int], tuple[int, int]]:
    """By slot (part and entry) and position: the change of the sum, and the largest squared distance."""

    def run(batches):
        sums = np.zeros((parts * entries, width), dtype=np.int64)
        counts, most = np.zeros(parts * entries, dtype=np.int64), np.full(parts * entries, -1, dtype=np.int64)
        for batch in _gathered(batches, _ROWS):
            n, points = batch.num_rows, _points(batch, parts * width)
            now, old = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(n, parts).astype(np.int64) for c in ("code", "before")
            )
            near = batch.column("near").flatten().to_numpy().reshape(n, parts)
            for p in range(parts):
                np.maximum.at(most, p * entries + now[:, p], near[:, p])
                moved = np.flatnonzero((now[:, p] != old[:, p]) | first)
                own = points[moved, p * width : (p + 1) * width].astype(np.int64)
                for slot, sign in ((now, 1), (old, -1)) if not first else ((now, 1),):
                    at = p * entries + slot[moved, p]
                    np.add.at(counts, at, sign)
                    np.add.at(sums, at, sign * own)
        slots, places = np.nonzero(sums)
        counted, reached = np.flatnonzero(counts), np.flatnonzero(most >= 0)
        columns = [
            np.concatenate([slots, counted, reached]),
            np.concatenate([places, np.full(len(counted), _COUNT), np.full(len(reached), _RADIUS)]),
            np.concatenate([sums[slots, places], counts[counted], most[reached]]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["slot", "place", "value"])

    told = state.mapInArrow(run, "slot long, place long, value long").groupBy("slot", "place")
    changed = F.when(F.col("place") != _RADIUS, F.col("value"))
    rows = told.agg(F.sum(changed).alias("total"), F.max("value").alias("most")).collect()  # bounded by the codebooks
    return {(r["slot"], r["place"]): (r["total"], r["most"]) for r in rows}


class _Stored:
    """The newest state in the shared folder; older ones are deleted."""

    def __init__(self, frame: DataFrame):
        self.spark, self.path = frame.sparkSession, None
        self.put(frame)

    def put(self, frame: DataFrame) -> None:
        path, old = scratch_path(self.spark, "vector-state"), self.path
        frame.write.parquet(path)
        self.path = path
        self.frame = self.spark.read.schema(frame.schema).parquet(path)
        if old:
            discard(self.spark, old)


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error) of the rows that take part, and the codebooks; code has one byte a part.

    Runs jobs: every round assigns all parts and sums them up.
    """
    rows = components(vectors, key, vector, label, scale)
    lengths = rows.groupBy(F.size("point").alias("length")).count().orderBy(F.desc("count"), "length").first()
    length = lengths["length"] if lengths else 0
    width = -(-length // parts)
    filled = F.concat("point", F.array_repeat(F.lit(0), parts * width - length))
    rows = rows.filter(F.size("point") == length).select("id", "label", filled.alias("point"))
    state = _Stored(rows.withColumn("code", F.lit(bytearray(parts))))
    first = state.frame.orderBy(F.asc_nulls_last("id"), "point").limit(entries).select("point").collect()
    books = np.array([r["point"] for r in first], dtype=np.int64).reshape(len(first), parts, max(width, 0)).transpose(1, 0, 2)
    schema = "label", "code", F.aggregate("near", F.lit(0).cast("long"), lambda total, d: total + d).alias("error")
    if not first:
        empty = state.frame.withColumn("near", F.array().cast("array<long>"))
        return empty.select(F.col("id").alias(key), *schema), Codebooks(books)
    books = np.ascontiguousarray(books)
    k = len(first)
    sums, counts, radii = np.zeros((parts, k, width), dtype=np.int64), np.zeros((parts, k), dtype=np.int64), None
    for done in range(rounds):
        state.put(_assigned(state.frame, books, radii))
        furthest = np.zeros((parts, k))
        for (slot, place), (total, most) in _changes(state.frame, parts, k, width, radii is None).items():
            p, entry = divmod(slot, k)
            if place == _RADIUS:
                furthest[p, entry] = np.sqrt(float(most))
            elif place == _COUNT:
                counts[p, entry] += total
            else:
                sums[p, entry, place] += total
        moved = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        radii = furthest + np.sqrt(((moved - books) ** 2).sum(axis=2).astype(float))
        books = moved
    state.put(_assigned(state.frame, books, radii))
    return state.frame.select(F.col("id").alias(key), *schema), Codebooks(books)


def with_label_error(coded: DataFrame, key: str = "vec_id") -> DataFrame:
    """`coded` with label_error: the error summed over rows of equal labels, nulls together."""
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if totals.count() <= BROADCAST_ROWS:
        same = coded["label"].eqNullSafe(totals["label"])
        return coded.join(F.broadcast(totals), same, "left").drop(totals["label"])
    salted = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    return dealt.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")), "left").drop("of", "part", "salt")
