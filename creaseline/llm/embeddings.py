"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one class with a count. Each tree splits the classes again and again at the median
of a random projection; what lies near the median, between the 40th and 60th percentile, goes to both
sides, so a close pair is rarely torn apart. The trees are drawn on a bounded sample, then every
class is routed through all of them. Within each leaf all pairs are compared, in blocks and in double
precision, so a link is never wrong; the many trees make a missed one rare.

Trees tear a large group of near vectors apart, so such groups are found in the sample first. Around
each lies a ball; whatever is linked to a vector inside is, by the triangle inequality of angles, at
most the link's angle outside. So the vectors inside are compared with each other and with these
visitors, in tiles of bounded size, and do not enter the trees; no link of theirs is missed.

Each class knows all leaves that it is in. A pair is counted only in the first leaf that its two
ends share, so the number of links is exact without ever listing the pairs. A leaf returns one row
per member: the links counted there, and a link to the smallest member of its part of the leaf, which
together span the components.

Defined cases: a null or zero vector, or one with a null or non-finite component, links with nothing,
also not with its like; vectors of different lengths never link; equal ids are vectors of their own;
a null id never names a component unless nothing else is in it; an empty table gives an empty table.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.llm.components import components
from creaseline.llm.simhash import forest
from creaseline.llm.workers import shipped
from creaseline.sources.storage import written

COSINE = 0.9
TREES = 6  # at least; as many as levels if these are more
LEAF = 1024  # classes that a leaf should hold
SPILL = 0.1  # share of a node on either side of its median that goes to both sides
SAMPLE = 50_000  # classes, in expectation, that the trees are drawn on
HOT = 4  # leaves that a group of near vectors fills before it gets a ball
TILE = 8192  # classes of a ball that meet as many others in one task
_PROBES = 4096  # members of the sample around which groups are looked for
_BLOCK = 1 << 20


@dataclass
class Node:
    direction: np.ndarray
    low: float  # what projects below `high` goes left, and from `low` on right
    high: float
    left: "Node | int"
    right: "Node | int"


@dataclass
class Ball:
    centre: np.ndarray
    inner: float  # angle up to which a vector is inside
    outer: float  # angle up to which it visits
    homes: int  # blocks of the vectors inside
    guests: int


def unit_rows(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of length 1 in double precision, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        v = np.asarray(v, dtype=np.float64)[:width]
        v = v / np.abs(v).max()  # so that the sum of squares stays finite
        out[i, : len(v)] = v / np.linalg.norm(v)
    return out


def _angles(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centre, -1, 1))


def find_balls(sample: np.ndarray, share: float, cosine: float, least: float, tile: int) -> tuple[list[Ball], np.ndarray]:
    """Balls around the groups of more than `least` classes, and the rest of the sample."""
    link, balls, rng = math.acos(cosine), [], np.random.default_rng(29)
    least = max(least * share, 8)
    probes = sample if len(sample) <= _PROBES else sample[rng.choice(len(sample), _PROBES, replace=False)]
    while len(sample) > least and len(probes):
        slices_ = [probes[n : n + 256] for n in range(0, len(probes), 256)]
        near = np.concatenate([(part @ sample.T >= cosine).sum(axis=1) for part in slices_])
        if near.max() <= least:
            break
        probes = probes[near > least]  # what is removed only lowers the counts
        group = sample[sample @ probes[near[near > least].argmax()] >= cosine]
        centre = group.mean(axis=0)
        centre /= np.linalg.norm(centre)
        angles = np.sort(_angles(sample, centre))
        radii = link * np.arange(4, 25) / 16
        inside, reached = (np.searchsorted(angles, radii + more, side="right") for more in (0, link))
        best = int(np.argmax(np.where(inside >= len(group) / 2, inside / (reached + 1), -1)))
        homes, guests = (max(1, math.ceil(n / share / tile)) for n in (inside[best], reached[best] - inside[best]))
        balls.append(Ball(centre, radii[best], radii[best] + link + 1e-6, homes, guests))
        sample = sample[_angles(sample, centre) > radii[best]]
        probes = probes[_angles(probes, centre) > radii[best]]
    return balls, sample


def place(balls: list[Ball], rows: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tile, block and place in `rows` of every copy, and which rows are in no ball.

    A row visits only balls before its own, so a pair meets in one tile. `mixed` deals out the blocks.
    """
    free = np.ones(len(rows), dtype=bool)
    tiles, blocks, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    for n, ball in enumerate(balls):
        angles = _angles(rows, ball.centre)
        home = free & (angles <= ball.inner)
        at, visiting = np.flatnonzero(home), np.flatnonzero(free & ~home & (angles <= ball.outer))
        own, guest = mixed[at] % ball.homes, ball.homes + mixed[visiting] % ball.guests
        for other in range(ball.homes + ball.guests):
            met = [(at, own, np.full(len(at), other))]
            if other < ball.homes:
                met.append((visiting, guest, np.full(len(visiting), other)))
            for who, block, facing in met:
                tiles.append((n << 40) + (np.minimum(block, facing) << 20) + np.maximum(block, facing))
                blocks.append(block.astype(np.int32))
                places.append(who)
        free &= ~home
    return np.concatenate(tiles), np.concatenate(blocks), np.concatenate(places), free


def tile_links(tile: int, blocks: np.ndarray, ids, counts, sizes, rows: np.ndarray, cosine: float):
    """(id, links, smallest member linked) of a tile: pairs within its block, or across its two."""
    n, (low, high) = len(ids), ((tile >> 20) & 0xFFFFF, tile & 0xFFFFF)
    a, b = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    links, label = np.zeros(n, dtype=np.int64), np.arange(n)
    step = max(1, _BLOCK // max(len(b), 1))
    for start in range(0, len(a), step):
        part = a[start : start + step]
        cosines = rows[part] @ rows[b].T
        near = cosines >= cosine
        i, j = np.nonzero(np.abs(cosines - cosine) < 1e-9)
        near[i, j] = np.einsum("ij,ij->i", rows[part[i]], rows[b[j]]) >= cosine
        near &= (sizes[part][:, None] == sizes[b]) & (part[:, None] != b)
        links[part] += np.where(near, counts[b], 0).sum(axis=1)
        if low != high:
            links[b] += np.where(near, counts[part][:, None], 0).sum(axis=0)
        i, j = np.nonzero(near & (label[part][:, None] != label[b]))
        if len(i):
            label = forest(n, np.concatenate([np.arange(n), part[i]]), np.concatenate([label, b[j]]))
    told = np.flatnonzero((links > 0) | (label != np.arange(n)))
    return ids[told], links[told], ids[label[told]]


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator, counter: list[int]) -> "Node | int":
    if depth > 0 and len(sample) >= 16:
        direction = rng.standard_normal(sample.shape[1])
        along = sample @ direction
        low, high = np.quantile(along, [0.5 - SPILL, 0.5 + SPILL])
        high = np.nextafter(high, np.inf)
        left, right = sample[along < high], sample[along >= low]
        if max(len(left), len(right)) < 0.9 * len(sample):
            return Node(direction, low, high, grow(left, depth - 1, rng, counter), grow(right, depth - 1, rng, counter))
    counter[0] += 1
    return counter[0]


def route(tree: "Node | int", rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Leaves with the places of the rows in them."""
    found, todo = [], [(tree, np.arange(len(rows)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            found.append((node, at))
        elif len(at):
            along = rows[at] @ node.direction
            todo += [(node.left, at[along < node.high]), (node.right, at[along >= node.low])]
    return found


def _shared_first(leaves: np.ndarray, i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """For which pairs `leaf` is the first that both are in; leaves are sorted, filled with -1 behind."""
    first = np.zeros(len(i), dtype=bool)
    for start in range(0, len(i), 50_000):
        a, b = leaves[i[start : start + 50_000]], leaves[j[start : start + 50_000]]
        open_ = np.arange(len(a))
        for column in range(leaves.shape[1]):
            if not len(open_):
                break
            value = a[open_, column]
            both = (value[:, None] == b[open_]).any(axis=1) & (value >= 0)
            first[start + open_[both]] = value[both] == leaf
            open_ = open_[~both]
    return first


def leaf_links(leaf: int, ids, counts, sizes, rows: np.ndarray, leaves: np.ndarray, cosine: float):
    """(id, links counted here, smallest member linked) for the members that have a link."""
    n = len(ids)
    links, a, b, held = np.zeros(n, dtype=np.int64), [], [], 0
    step = max(1, _BLOCK // max(n, 1))
    for start in range(0, n, step):
        near = rows[start : start + step] @ rows[start:].T >= cosine - 1e-9
        i, j = np.nonzero(near)
        i, j = i[i < j] + start, j[i < j] + start
        sure = (np.einsum("ij,ij->i", rows[i], rows[j]) >= cosine) & (sizes[i] == sizes[j])
        i, j = i[sure], j[sure]
        counted = _shared_first(leaves, i, j, leaf)
        np.add.at(links, i[counted], counts[j[counted]])
        np.add.at(links, j[counted], counts[i[counted]])
        a.append(i)
        b.append(j)
        held += len(i)
        if held > 2_000_000:
            label = forest(n, np.concatenate(a), np.concatenate(b))
            a, b, held = [np.arange(n)], [label], n
    label = forest(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)
    told = np.flatnonzero((links > 0) | (label != np.arange(n)))
    return ids[told], links[told], ids[label[told]]


def _vectors(column) -> list[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return np.split(flat, offsets[1:-1]) if len(offsets) > 1 else []


def class_links(classes: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(cid, links, tied) from every leaf, for classes (cid, vector, n)."""
    total, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    schema = "leaf long, cid long, n long, size int, vector array<double>, leaves array<long>"
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = classes if share == 1.0 else classes.filter(F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = unit_rows([np.array(r[0]) for r in drawn.select("vector").collect()], width or 1)
    balls, sample = find_balls(sample, share, cosine, HOT * leaf, TILE)
    depth = max(0, math.ceil(math.log2(max(total, 1) / leaf)))
    counter = [0]
    roots = [grow(sample, depth, np.random.default_rng(seed), counter) for seed in range(max(trees, depth))]
    shared = shipped(classes.sparkSession, (balls, roots))

    def mixed(ids):
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)).astype(np.int64)

    def deal(batches):
        balls = shared()[0]
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                vectors = _vectors(part.column("vector"))
                rows, ids = unit_rows(vectors, width), part.column("cid").to_numpy()
                sizes = np.array([len(v) for v in vectors], dtype=np.int32)
                tiles, blocks, at, _ = place(balls, rows, mixed(ids))
                for begin in range(0, len(at), 20_000):
                    cut = slice(begin, begin + 20_000)
                    own = at[cut]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width), pa.array(rows[own].ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tiles[cut]), pa.array(blocks[cut]), pa.array(ids[own]), pa.array(part.column("n").to_numpy()[own]), pa.array(sizes[own]), flat],
                        ["tile", "block", "cid", "n", "size", "vector"],
                    )

    def meet(table):
        rows = table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, width)
        columns = [table.column(c).to_numpy() for c in ("block", "cid", "n", "size")]
        ids, links, tied = tile_links(table.column("tile")[0].as_py(), *columns, rows, cosine)
        return pa.table({"cid": ids, "links": links, "tied": tied})

    def spread(batches):
        balls, roots = shared()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                vectors = _vectors(part.column("vector"))
                rows = unit_rows(vectors, width)
                free = np.flatnonzero(place(balls, rows, np.zeros(len(rows), dtype=np.int64))[3])
                if not len(free):
                    continue
                part, rows, vectors = part.take(pa.array(free)), rows[free], [vectors[i] for i in free]
                placed = [found for root in roots for found in route(root, rows)]
                leaf_of = np.concatenate([np.full(len(at), name) for name, at in placed])
                at = np.concatenate([at for _, at in placed])
                order = np.lexsort((leaf_of, at))
                bounds = np.searchsorted(at[order], np.arange(len(rows) + 1))
                own = [leaf_of[order[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
                ids, counts = part.column("cid").to_numpy(), part.column("n").to_numpy()
                sizes = np.array([len(v) for v in vectors], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leaf_of.astype(np.int64)), pa.array(ids[at]), pa.array(counts[at]), pa.array(sizes[at]),
                        pa.array([rows[i] for i in at], pa.list_(pa.float64())),
                        pa.array([own[i] for i in at], pa.list_(pa.int64())),
                    ],
                    ["leaf", "cid", "n", "size", "vector", "leaves"],
                )

    def compare(table):
        column = table.column("leaves").combine_chunks()
        own = _vectors(column)
        leaves = np.full((len(own), max(map(len, own))), -1, dtype=np.int64)
        for i, names in enumerate(own):
            leaves[i, : len(names)] = names
        rows = table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, width)
        ids, links, tied = leaf_links(
            table.column("leaf")[0].as_py(), table.column("cid").to_numpy(), table.column("n").to_numpy(),
            table.column("size").to_numpy(), rows, leaves, cosine,
        )
        return pa.table({"cid": ids, "links": links, "tied": tied})

    routed = classes.select("cid", "n", "vector").mapInArrow(spread, schema)
    told = "cid long, links long, tied long"
    found = routed.groupBy("leaf").applyInArrow(compare, told)
    if not balls:
        return found
    dealt = classes.select("cid", "n", "vector").mapInArrow(deal, "tile long, block int, cid long, n long, size int, vector array<double>")
    return found.union(dealt.groupBy("tile").applyInArrow(meet, told))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Per vector: key, n_links, component_id and kept."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.filter("usable")
    classes = good.groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = written(class_links(classes, cosine, trees, leaf), "vector-links")
    tied = written(components(found, "cid", "tied"), "vector-components")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = tied.join(classes.select("cid", "first"), tied.node == F.col("cid"))
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    first = tied.join(smallest, "component").select(F.col("node").alias("cid"), "smallest")
    known = written(
        classes.join(links, "cid", "left").join(first, "cid", "left").select(
            "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("smallest", "first").alias("component_id"),
        ),
        "vector-results",
    )
    linked = good.join(known, "vector").select("id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
