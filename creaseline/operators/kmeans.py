"""K-Means over short vectors, all restarts side by side, in whole numbers.

Components are scaled to integers, so the sums of a step do not depend on partitions, and centres
follow from them exactly. The seeds of a start are drawn with chances in proportion to the squared
distance to those it has: by the smallest of -ln(u) / distance, where u is a hash of the player.
"""

import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.params import Params

SCALE = 1 << 24
_BLOCK = 4096

# Tasks get these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole_points(z: str) -> Column:
    return F.transform(z, lambda x: F.round(x * SCALE).cast("bigint"))


def points_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("point")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _apart(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by point, start and centre; each by the same operations in any batch."""
    return ((points[:, None, None, :] - centres[None]) ** 2).sum(axis=3)


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """By point and start: the nearest centre, the first of several."""
    blocks = [_apart(points[at : at + _BLOCK], centres).argmin(axis=2) for at in range(0, len(points), _BLOCK)]
    return np.concatenate(blocks) if blocks else np.zeros((0, len(centres)), dtype=np.int64)


def _seeds(points: DataFrame, params: Params) -> np.ndarray:
    """By start and cluster: centres, drawn one after the other for all starts at once."""
    starts = params.kmeans_restarts
    centres = None
    for step in range(params.archetypes):

        def draw(batches, known=centres, step=step):
            best = [None] * starts
            for batch in batches:
                rows = points_of(batch)
                weight = np.ones((len(rows), starts))
                if known is not None:
                    blocks = [_apart(rows[at : at + _BLOCK], known).min(axis=2) for at in range(0, len(rows), _BLOCK)]
                    weight = np.concatenate(blocks) if blocks else weight
                hashed = batch.column("hash").to_numpy().view(np.uint64)
                for start in range(starts):
                    salt = np.uint64(((params.kmeans_seed + start) * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                    mixed = (hashed ^ salt) * np.uint64(0xD6E8FEB86659FD93)
                    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    u = ((mixed >> np.uint64(11)).astype(float) + 1) / (2.0**53 + 1)
                    with np.errstate(divide="ignore"):
                        rank = np.where(weight[:, start] > 0, -np.log(u) / weight[:, start], np.inf)
                    for at in np.flatnonzero(rank == rank.min()) if len(rank) else ():
                        found = (float(rank[at]), rows[at].tolist())
                        best[start] = found if best[start] is None else min(best[start], found)
            told = [(start, *found) for start, found in enumerate(best) if found]
            columns = [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["start", "rank", "point"])

        hashed = points.select("point", F.xxhash64("player").alias("hash"))
        drawn = hashed.mapInArrow(draw, "start int, rank double, point array<bigint>")
        # One row for each start.
        rows = drawn.groupBy("start").agg(F.min(F.struct("rank", "point")).alias("best")).orderBy("start").collect()
        new = np.array([r["best"]["point"] for r in rows], dtype=float)[:, None, :]
        centres = new if centres is None else np.concatenate([centres, new], axis=1)
    return centres


def _sums(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the members' components, and their numbers, by start and cluster; whole numbers."""
    starts, k, width = centres.shape

    def add(batches):
        totals = np.zeros((starts, k, width + 1), dtype=np.int64)
        for batch in batches:
            rows = points_of(batch)
            counted = np.concatenate([rows, np.ones((len(rows), 1), dtype=np.int64)], axis=1)
            chosen = nearest_centres(rows, centres)
            for start in range(starts):
                np.add.at(totals[start], chosen[:, start], counted)
        at = np.flatnonzero(totals.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals.ravel()[at])], ["at", "value"])

    totals = np.zeros(starts * k * (width + 1), dtype=np.int64)
    told = points.select("point").mapInArrow(add, "at bigint, value bigint").groupBy("at").agg(F.sum("value").alias("value"))
    for row in told.collect():  # bounded by starts, clusters and components
        totals[row["at"]] = row["value"]
    totals = totals.reshape(starts, k, width + 1)
    return totals[:, :, :width], totals[:, :, width]


def best_centres(points: DataFrame, params: Params) -> np.ndarray:
    """The centres, in scaled units, of the start with the least squared error; (player, point) rows."""
    centres = _seeds(points, params)
    for _ in range(params.kmeans_iterations):
        sums, counts = _sums(points, centres)
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres)
        if (moved == centres).all():
            break
        centres = moved
    sums, counts = _sums(points, centres)

    def kept(start):
        """What the clusters explain, exactly; the error is a constant less this."""
        return sum((Fraction(sum(int(x) ** 2 for x in s), int(n)) for s, n in zip(sums[start], counts[start]) if n), Fraction(0))

    return centres[max(range(len(centres)), key=lambda start: (kept(start), -start))]
