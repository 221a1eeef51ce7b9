"""Exact top-k cosine neighbours without comparing all pairs.

On unit vectors the closest by cosine are the closest by distance, so the search can prune by
distance: ||u - v||^2 = 2 - 2 cos(u, v).

1. Players with the same direction form one point. A point keeps its first k + 1 names, which is
   all that any player can need of it, so copies cost nothing.
2. Points are cut into leaves by median planes taken from a sample. The sample only decides where
   the planes lie. A leaf that still came out large is split into blocks by hash.
3. Each point searches its own leaf. Its (k + 1)-th best distance there bounds the search: only
   leaves whose bounding box lies nearer can hold a better neighbour, and those are searched too.

Every task compares one bounded slice of points with one bounded block and returns only the best
k + 1 per point. A population that fits one leaf is a single block.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creaseline.functions import half_even
from creaseline.sources.storage import written

MAX_LEAVES = 16384
SAMPLE_PER_LEAF = 16
# Similarities that differ by less than this are float noise and count as ties, settled by name.
TIE_DIGITS = 12
PRUNE_SLACK = 1e-9  # in squared distance; far above the tie width

_FOUND = (
    "role string, lead string, unit array<double>, leaf int,"
    " sims array<double>, clones array<string>"
)


@dataclass(frozen=True)
class Planes:
    """Median planes as an implicit binary tree: node i has children 2i + 1 and 2i + 2."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    def leaf_of(self, units: np.ndarray) -> np.ndarray:
        node = np.zeros(len(units), dtype=np.int64)
        rows = np.arange(len(units))
        for _ in range(self.depth):
            right = units[rows, self.axis[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - (2 ** self.depth - 1)


def median_planes(sample: np.ndarray, depth: int) -> Planes:
    """Halve the sample `depth` times along its widest axis."""
    nodes = 2 ** depth - 1
    axis, cut = np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
    members = {0: sample}
    for node in range(nodes):
        part = members.pop(node)
        if len(part):
            axis[node] = int(np.argmax(np.ptp(part, axis=0)))
            cut[node] = float(np.median(part[:, axis[node]]))
        right = part[:, axis[node]] > cut[node]
        members[2 * node + 1], members[2 * node + 2] = part[~right], part[right]
    return Planes(depth, axis, cut)


def best_of_block(
    queries: np.ndarray, block: np.ndarray, keep: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the `keep` most similar block rows with a positive similarity.

    Returns flat (query, row, similarity) sorted by query, falling similarity, row. Block rows come
    sorted by name, so the row number settles ties.
    """
    sims = np.round(queries @ block.T, TIE_DIGITS)
    if sims.shape[1] > keep:
        floor = np.partition(sims, sims.shape[1] - keep, axis=1)[:, -keep, None]
    else:
        floor = np.full((len(sims), 1), -1.0)
    query, row = np.nonzero((sims >= floor) & (sims > 0))
    score = sims[query, row]
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < keep
    return query[kept], row[kept], score[kept]


def _search(keep: int):
    def search(asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or block.empty:
            return pd.DataFrame(columns=["role", "lead", "unit", "leaf", "sims", "clones"])
        named = block.explode("names").sort_values("names", kind="stable")
        candidates = np.vstack(named["unit"].to_numpy())
        names = named["names"].to_numpy()
        units = np.vstack(asking["unit"].to_numpy())
        sims, clones = [], []
        for start in range(0, len(units), 512):
            part = units[start:start + 512]
            query, row, score = best_of_block(part, candidates, keep)
            edges = np.searchsorted(query, np.arange(len(part) + 1))
            for left, right in zip(edges[:-1], edges[1:]):
                sims.append(score[left:right].tolist())
                clones.append(names[row[left:right]].tolist())
        return pd.DataFrame({
            "role": asking["role"].to_numpy(), "lead": asking["lead"].to_numpy(),
            "unit": asking["unit"].to_numpy(), "leaf": asking["leaf"].to_numpy(),
            "sims": sims, "clones": clones,
        })

    return search


def _compare(asking: DataFrame, points: DataFrame, blocks, slices, keep: int) -> DataFrame:
    """Search each asking row's target leaf.

    `blocks` and `slices` are (role, leaf) -> number of hash blocks of the leaf, and number of
    slices of the rows that ask it; both keep one task's share bounded.
    """
    part = F.xxhash64("lead")
    asking = (
        # Renaming gives columns of their own to a side that may be the points themselves.
        _with_counts(asking.toDF(*asking.columns), blocks, slices)
        .withColumn("slice", F.pmod(part, "slices").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    points = (
        _with_counts(points, blocks, slices)
        .withColumn("block", F.pmod(part, "blocks").cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    )
    unit = ["role", "leaf", "block", "slice"]
    return (
        asking.groupBy(*unit).cogroup(points.groupBy(*unit)).applyInPandas(_search(keep), _FOUND)
    )


def _with_counts(rows: DataFrame, blocks: dict, slices: dict) -> DataFrame:
    """Add the leaf's `blocks` and `slices`; at most MAX_LEAVES entries per role are broadcast."""
    listed = [
        (*key, int(blocks.get(key, 1)), int(slices.get(key, 1)))
        for key in sorted(set(blocks) | set(slices))
    ]
    if not listed:
        return rows.withColumns({"blocks": F.lit(1), "slices": F.lit(1)})
    counts = rows.sparkSession.createDataFrame(
        listed, "role string, leaf int, blocks int, slices int"
    )
    return (
        rows.join(F.broadcast(counts), ["role", "leaf"], "left")
        .fillna(1, ["blocks", "slices"])
    )


def _merge(found: DataFrame, keep: int) -> DataFrame:
    """The best `keep` over all leaves a point searched, as an array of (similarity, clone)."""
    ranked = F.array_sort(
        F.flatten(F.collect_list(F.transform(
            F.arrays_zip("sims", "clones"),
            lambda pair: F.struct((-pair["sims"]).alias("fall"), pair["clones"].alias("clone")),
        )))
    )
    return (
        found.groupBy("role", "lead")
        .agg(
            F.slice(ranked, 1, keep).alias("best"),
            F.first("unit").alias("unit"), F.first("leaf").alias("leaf"),
        )
    )


def _leaf_column(planes: dict[str, Planes]):
    @F.pandas_udf("int")
    def leaf(role: pd.Series, unit: pd.Series) -> pd.Series:
        out = np.zeros(len(role), dtype=np.int32)
        for name, group in unit.groupby(role).groups.items():
            if name in planes:
                at = unit.index.get_indexer(group)
                out[at] = planes[name].leaf_of(np.vstack(unit.loc[group].to_numpy()))
        return pd.Series(out)

    return leaf("role", "unit")


def _reach_column(boxes: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Leaves other than the own one whose box lies within the point's search distance."""

    @F.pandas_udf("array<int>")
    def reach(role: pd.Series, leaf: pd.Series, unit: pd.Series, worst: pd.Series) -> pd.Series:
        out = np.empty(len(role), dtype=object)
        units = unit.to_numpy()
        limit = 2.0 - 2.0 * worst.to_numpy() + PRUNE_SLACK
        roles, own = role.to_numpy(), leaf.to_numpy()
        for start in range(0, len(roles), 128):
            for name in set(roles[start:start + 128]):
                at = start + np.nonzero(roles[start:start + 128] == name)[0]
                leaves, low, high = boxes[name]
                own_units = np.vstack(units[at])
                gap = np.zeros((len(at), len(leaves)))
                for axis in range(low.shape[1]):
                    x = own_units[:, axis, None]
                    gap += np.square(np.maximum(0.0, np.maximum(low[:, axis] - x,
                                                                x - high[:, axis])))
                near = (gap <= limit[at, None]) & (leaves[None, :] != own[at, None])
                for i, row in zip(at, near):
                    out[i] = leaves[row].tolist()
        return pd.Series(out)

    return reach("role", "leaf", "unit", "worst")


def _plan_leaves(points: DataFrame, leaf_size: int) -> dict[str, Planes]:
    planes = {}
    for role, count in points.groupBy("role").count().collect():  # one row per role
        depth = 0
        while count > leaf_size * 2 ** depth and 2 ** depth < MAX_LEAVES:
            depth += 1
        if depth:
            wanted = SAMPLE_PER_LEAF * 2 ** depth
            own = points.filter(F.col("role") == role).select("unit")
            share = min(1.0, wanted / count)
            sample = own.sample(share, seed=7).limit(2 * wanted).collect()
            if sample:
                planes[role] = median_planes(np.array([row["unit"] for row in sample]), depth)
    return planes


def nearest(vectors: DataFrame, k: int, leaf_size: int = 2048) -> DataFrame:
    """(player, clone, similarity, clone_rank, role) from unit vectors (role, player, unit).

    Ranks by falling similarity, then clone name; only positive similarities count. All vectors of
    a role have the same length.
    """
    keep = k + 1
    vectors = written(vectors.select("role", "player", "unit"), "vectors")
    same = Window.partitionBy("role", "unit").orderBy("player")
    points = written(
        vectors.withColumn("place", F.row_number().over(same))
        .filter(F.col("place") <= keep)
        .groupBy("role", "unit")
        .agg(F.array_sort(F.collect_list("player")).alias("names"))
        .withColumn("lead", F.col("names")[0]),
        "points",
    )
    planes = _plan_leaves(points, leaf_size)
    if not planes:
        points = points.withColumn("leaf", F.lit(0))
        found = _compare(points, points, {}, {}, keep)
    else:
        points = written(points.withColumn("leaf", _leaf_column(planes)), "leaves")
        found = _search_leaves(points, leaf_size, keep)
    best = _merge(found, keep)
    others = F.filter("best", lambda pair: pair["clone"] != F.col("player"))
    ranked = F.transform(
        F.slice(others, 1, k),
        lambda pair, at: F.struct(
            pair["clone"].alias("clone"), (-pair["fall"]).alias("score"),
            (at + 1).cast("int").alias("clone_rank"),
        ),
    )
    return (
        vectors.join(best.select("role", "unit", "best"), ["role", "unit"])
        .select("role", "player", F.inline(ranked))
        .withColumn("similarity", F.expr(half_even("score", 4)))
        .select("player", "clone", "similarity", "clone_rank", "role")
    )


def _search_leaves(points: DataFrame, leaf_size: int, keep: int) -> DataFrame:
    size = len(points.select("unit").first()["unit"])
    width = points.groupBy("role").agg(F.max(F.size("unit")).alias("n")).collect()
    axes = max(row["n"] for row in width) if width else size
    bounds = points.groupBy("role", "leaf").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(F.get("unit", F.lit(i))) for i in range(axes)]).alias("low"),
        F.array(*[F.max(F.get("unit", F.lit(i))) for i in range(axes)]).alias("high"),
    ).collect()  # at most MAX_LEAVES rows per role
    blocks = {(row["role"], row["leaf"]): -(-row["n"] // (2 * leaf_size)) for row in bounds}
    boxes = {}
    for role in {row["role"] for row in bounds}:
        rows = [row for row in bounds if row["role"] == role]
        boxes[role] = (
            np.array([row["leaf"] for row in rows]),
            np.array([[x for x in row["low"] if x is not None] for row in rows]),
            np.array([[x for x in row["high"] if x is not None] for row in rows]),
        )
    own = written(_merge(_compare(points, points, blocks, blocks, keep), keep), "own-leaf")
    last = F.col("best")[keep - 1]["fall"]
    worst = F.when(F.size("best") < keep, F.lit(0.0)).otherwise(-last)
    asking = written(
        own.withColumn("worst", worst)
        .withColumn("leaf", F.explode(_reach_column(boxes)))
        .select("role", "lead", "unit", "leaf"),
        "asking",
    )
    asked = asking.groupBy("role", "leaf").count().collect()  # at most MAX_LEAVES rows per role
    slices = {(row["role"], row["leaf"]): -(-row["count"] // (4 * leaf_size)) for row in asked}
    found_own = own.select(
        "role", "lead", "unit", "leaf",
        F.transform("best", lambda pair: -pair["fall"]).alias("sims"),
        F.transform("best", lambda pair: pair["clone"]).alias("clones"),
    )
    return found_own.unionByName(_compare(asking, points, blocks, slices, keep))


# Tasks get these functions with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
