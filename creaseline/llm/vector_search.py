"""Nearest vectors by cosine, through vantage-point trees in every shard.

The angle between vectors is a metric. A vantage-point tree cuts a set again and again by the angle
to a vantage vector; the triangle inequality bounds from below the angle between a query and all that
lies on one side. A side is left out if `factor` times its bound exceeds the angle of the query's
k-th best so far. With a factor of one this loses nothing and the search is exact; larger factors
leave out more and may lose neighbours.

1. Equal vectors become one point, which keeps its k + 1 smallest ids: all that any query can need.
2. A tree drawn on a bounded sample deals the points into cells of space. A cell is dealt by hash into
   as many shards as its size asks for, so that a shard is bounded whatever the data, and each shard
   gets a tree of its own, built where it is searched.
3. Each different query vector first searches its own cell; its k-th best there is the limit with
   which it goes on to the other cells, but for those that the bounds leave out. In a shard it takes
   the leaves of the tree in the order of their bounds, until these exceed its limit.
4. Scores are computed again from the original vectors, in the same order of operations for every
   pair, and settle the ranks; a query's own row is taken out last.

Defined cases: a vector that is null, zero, empty, or holds null or non-finite components takes no
part, neither as query nor as candidate; vectors of different lengths are never neighbours; copies
of a query's vector are neighbours like any other; rows with the query's own id are never its
neighbours, and an id that occurs twice as a candidate is listed for each row; repeated query rows
are answered once; a null id is no query and no candidate; with fewer candidates than k all of them
are returned; an empty table gives an empty table. Other columns do not matter.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creaseline.sources.storage import written

K = 5
FACTOR = 3.0
SHARD = 8192  # points of a shard
LEAF = 256  # points of a leaf in a shard's tree
SAMPLE = 32_768  # points, in expectation, that the tree of cells is drawn on
ASKING = 4096  # queries that meet a shard in one task
SALTS = 16
_LEAST = 8  # sample members of a cell, so there are at most SAMPLE / _LEAST cells
_SLACK = 1e-6  # angles; far above the rounding of an arc cosine
_SPARE = 3  # points kept above k + 1 until the exact scores are known


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


class VantageTree:
    """Inner nodes by number, parents first: vantage vectors, children, and each side's angles.

    A child below 0 is leaf -1 - child.
    """

    def __init__(self, vantage: np.ndarray, children: np.ndarray, reach: np.ndarray, leaves: int):
        self.vantage, self.children, self.reach, self.leaves = vantage, children, reach, leaves

    @classmethod
    def build(cls, points: np.ndarray, size: float) -> tuple["VantageTree", list[np.ndarray]]:
        """Cut until leaves have at most `size` points; also the points of each leaf.

        A side's angles are those of its points; a set that no vantage separates stays a leaf.
        """
        rng, vantage, children, reach, leaves = np.random.default_rng(17), [], [], [], []
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            at, parent, side = todo.pop()
            cut = cls._cut(points, at, rng) if len(at) > size else None
            if cut is None:
                leaves.append(at)
                name = -len(leaves)
            else:
                centre, near, angle = cut
                name = len(vantage)
                vantage.append(centre)
                children.append([0, 0])
                reach.append([[angle[near].min(), angle[near].max()], [angle[~near].min(), angle[~near].max()]])
                todo += [(at[~near], name, 1), (at[near], name, 0)]
            if parent is not None:
                children[parent][side] = name
        tree = cls(
            np.array(vantage).reshape(-1, points.shape[1]), np.array(children, dtype=np.int64).reshape(-1, 2),
            np.array(reach).reshape(-1, 2, 2), len(leaves),
        )
        return tree, leaves

    @staticmethod
    def _cut(points: np.ndarray, at: np.ndarray, rng):
        """Of some vantages the one whose angles spread most around their median."""
        best = None
        looked = at if len(at) <= 1024 else rng.choice(at, 1024, replace=False)
        for v in rng.choice(at, min(len(at), 8), replace=False):
            angle = angles(points[looked], points[v : v + 1])[:, 0]
            spread = np.abs(angle - np.median(angle)).mean()
            if best is None or spread > best[0]:
                best = spread, v
        centre = points[best[1]]
        angle = angles(points[at], centre[None])[:, 0]
        middle = np.median(angle)
        near = angle < middle if (angle < middle).any() else angle <= middle
        return None if near.all() else (centre, near, angle)

    def thresholds(self) -> "VantageTree":
        """The same cuts for any points: a side reaches from its cut as far as angles go."""
        reach = np.empty_like(self.reach)
        if len(reach):
            cut = (self.reach[:, 0, 1] + self.reach[:, 1, 0]) / 2
            reach[:, 0], reach[:, 1] = np.stack([np.zeros_like(cut), cut], 1), np.stack([cut, np.full_like(cut, np.pi)], 1)
        return VantageTree(self.vantage, self.children, reach, self.leaves)

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row by the cuts of `thresholds`."""
        leaf = np.zeros(len(rows), dtype=np.int64)
        todo = [(0 if len(self.vantage) else -1, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                leaf[at] = -1 - node
            elif len(at):
                near = angles(rows[at], self.vantage[node][None])[:, 0] <= self.reach[node, 0, 1]
                todo += [(self.children[node, 0], at[near]), (self.children[node, 1], at[~near])]
        return leaf

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """By query and leaf: no point of the leaf is at a smaller angle."""
        out = np.zeros((len(queries), self.leaves))
        angle = angles(queries, self.vantage)
        least = {0: np.zeros(len(queries))}
        for node in range(len(self.vantage)):
            above = least.pop(node)
            for side in (0, 1):
                low, high = self.reach[node, side]
                bound = np.maximum(above, np.maximum(low - angle[:, node], angle[:, node] - high))
                child = self.children[node, side]
                if child < 0:
                    out[:, -1 - child] = bound
                else:
                    least[child] = bound
        return out


def search(points: np.ndarray, queries: np.ndarray, limits: np.ndarray, keep: int, k: int, factor: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Places in `points` and cosines of the `keep` nearest found for each query; -1 where none is.

    `limits`: the angle of each query's k-th best elsewhere, or pi. Equal cosines go by place.
    """
    tree, leaves = VantageTree.build(points, leaf)
    bounds = tree.bounds(queries)
    order = np.argsort(bounds, axis=1, kind="stable")
    limits = limits.copy()
    found, cosines = np.full((len(queries), keep), -1, dtype=np.int64), np.full((len(queries), keep), -np.inf)
    open_ = np.arange(len(queries))
    for turn in range(tree.leaves):
        target = order[open_, turn]
        going = factor * bounds[open_, target] <= limits[open_] + _SLACK
        open_, target = open_[going], target[going]
        if not len(open_):
            break
        by_leaf = np.argsort(target, kind="stable")
        names, starts = np.unique(target[by_leaf], return_index=True)
        for name, asking in zip(names.tolist(), np.split(open_[by_leaf], starts[1:])):
            members = leaves[name]
            new = queries[asking] @ points[members].T
            both = np.concatenate([cosines[asking], new], axis=1)
            who = np.concatenate([found[asking], np.broadcast_to(members, new.shape)], axis=1)
            best = np.lexsort((who, -both), axis=1)[:, :keep]
            cosines[asking], found[asking] = np.take_along_axis(both, best, 1), np.take_along_axis(who, best, 1)
            kth = cosines[asking, k - 1]
            limits[asking] = np.minimum(limits[asking], np.where(np.isfinite(kth), np.arccos(np.clip(kth, -1, 1)), np.pi))
    return found, cosines


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row and the row beside it."""
    dot, aa, bb = np.einsum("ij,ij->i", a, b), np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _packed(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Vectors scaled by a power of two, so that no square overflows and no bit is lost."""
    column = batch.column("vector")
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    rows = np.split(flat, (offsets - offsets[0])[1:-1]) if len(column) else []
    return [np.ldexp(v, -np.frexp(np.abs(v).max())[1]) + 0.0 for v in rows]


def _rows(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), width)


def vectors_of(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, same, width, point) of the rows that take part; `same` is equal for equal vectors."""
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vector").isNotNull()).filter(finite).filter(F.exists("vector", lambda x: x != 0))

    def run(batches):
        for batch in batches:
            raw = [v.astype("<f8").tobytes() for v in _packed(batch)]
            same = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(same, pa.binary()), pa.array([len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())],
                ["id", "same", "width", "point"],
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, same binary, width int, point binary")


def points_of(rows: DataFrame, names: int) -> DataFrame:
    """(same, width, point, ids): one row per different vector, with its smallest ids."""
    order = Window.partitionBy("same").orderBy("id")
    first = rows.select("id", "same").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= names)
    ids = first.groupBy("same").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("same").agg(F.first("width").alias("width"), F.first("point").alias("point"))
    return one.join(ids, "same")


def _cell_trees(points: DataFrame, shard: int) -> dict[int, tuple]:
    """For each width of a bounded sample, the arrays of a tree of cells."""
    total = points.count()
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = points if share == 1.0 else points.filter(F.pmod(F.xxhash64("same"), F.lit(1_000_000)) < int(share * 1_000_000))
    by_width: dict[int, list[bytes]] = {}
    for row in drawn.orderBy("same").select("width", "point").collect():
        by_width.setdefault(row["width"], []).append(bytes(row["point"]))
    trees = {}
    for width, raw in by_width.items():
        sample = units(np.frombuffer(b"".join(raw), dtype="<f8").reshape(-1, width))
        tree = VantageTree.build(sample, max(shard * share, _LEAST))[0].thresholds()
        trees[width] = (tree.vantage, tree.children, tree.reach, tree.leaves)
    return trees


def _by_width(batch, trees):
    """(places, unit rows, tree or None) for each width of a batch."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        rows = units(_rows(batch.column("point").take(pa.array(at)), width))
        yield at, rows, VantageTree(*trees[width]) if width in trees else None


def _search_shards(points: DataFrame, asking: DataFrame, shards: dict, k: int, factor: float, id_type: str) -> DataFrame:
    """(same, score, ids) found for each asking row in all shards of its target cell.

    `shards`: by width and cell, into how many shards the cell is dealt.
    """
    spark = points.sparkSession
    listed = [(*cell, n) for cell, n in shards.items() if n > 1]
    counts = spark.createDataFrame(listed, "width int, cell long, shards int")
    counts = F.broadcast(counts)  # one row for a cell of the sample's tree
    asked = asking.groupBy("width", "cell").count().filter(F.col("count") > ASKING)
    slices = [(r["width"], r["cell"], -(-r["count"] // ASKING)) for r in asked.collect()]  # one row for a cell
    slices = F.broadcast(spark.createDataFrame(slices, "width int, cell long, slices int"))

    def dealt(rows):
        return rows.join(counts, ["width", "cell"], "left").join(slices, ["width", "cell"], "left").fillna(1, ["shards", "slices"])

    part = F.xxhash64("same")
    homes = dealt(points).withColumn("shard", F.pmod(part, "shards")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - F.lit(1).cast("long"))))
    visits = dealt(asking.toDF(*asking.columns)).withColumn("slice", F.pmod(part, "slices")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - F.lit(1).cast("long"))))
    unit = ["width", "cell", "shard", "slice"]
    keep = k + 1 + _SPARE

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"same": pa.array([], pa.binary()), "score": pa.array([], pa.float64()), "ids": pa.array([], left.schema.field("ids").type)})
        left = left.sort_by([("lead", "ascending"), ("same", "ascending")])
        width = left.column("width")[0].as_py()
        own, asked = (_rows(side.column("point"), width) for side in (left, right))
        found, _ = search(units(own), units(asked), right.column("limit").to_numpy(), keep, k + 1, factor)
        query, place = np.nonzero(found >= 0)
        who = found[query, place]
        score = np.concatenate([scores(own[who[n : n + 65536]], asked[query[n : n + 65536]]) for n in range(0, len(who), 65536)])
        return pa.table({
            "same": right.column("same").take(pa.array(query)), "score": pa.array(score), "ids": left.column("ids").take(pa.array(who)),
        })

    homes = homes.select(*unit, "same", "point", "ids", F.col("ids")[0].alias("lead"))
    visits = visits.select(*unit, "same", "point", "limit")
    return homes.groupBy(*unit).cogroup(visits.groupBy(*unit)).applyInArrow(meet, f"same binary, score double, ids array<{id_type}>")


def _best(found: DataFrame, most: int) -> DataFrame:
    """(same, best): the best `most` (fall, id) of each query vector, best first; fall is the score below zero."""
    pairs = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("fall"), i.alias("id")))))
    return found.groupBy("same").agg(F.slice(F.array_sort(pairs), 1, most).alias("best"))


def nearest(
    vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding",
    k: int = K, factor: float = FACTOR, shard: int = SHARD,
) -> DataFrame:
    """(query_id, rank, key, score): up to `k` nearest rows for each row with `asked`, nearest first.

    `asked` is a condition on `vectors`. Runs jobs: points are written and the cells drawn on a sample.
    """
    rows = written(vectors_of(vectors, key, vector), "search-vectors")
    id_type = rows.schema["id"].dataType.simpleString()
    points = written(points_of(rows, k + 1), "search-classes")
    queries = vectors.filter(asked).select(F.col(key).alias("id")).distinct()
    queries = written(rows.join(queries, "id", "left_semi").select("id", "same").distinct(), "search-queries")
    trees = _cell_trees(points, shard)
    shared = points.sparkSession.sparkContext.broadcast(trees)  # plain arrays of bounded size

    def place(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int64)
            for at, own, tree in _by_width(batch, shared.value):
                if tree is not None:
                    cell[at] = tree.route(own)
            yield batch.append_column("cell", pa.array(cell))

    placed = points.mapInArrow(place, f"same binary, width int, point binary, ids array<{id_type}>, cell long")
    placed = written(placed, "search-cells")
    sizes = placed.groupBy("width", "cell").count().collect()  # one row for a cell of the sample's tree
    shards = {(r["width"], r["cell"]): -(-r["count"] // shard) for r in sizes}
    asking = placed.join(queries.select("same").distinct(), "same", "left_semi").select("same", "width", "point", "cell")
    asking = written(asking.withColumn("limit", F.lit(float(np.pi))), "search-asking")
    near = written(_search_shards(placed, asking, shards, k, factor, id_type), "search-own-cell")
    last = F.col("best")[k]["fall"]  # of k + 1, as the query itself is among them
    limit = F.when(F.size("best") > k, F.acos(F.greatest(F.least(-last, F.lit(1.0)), F.lit(-1.0)))).otherwise(float(np.pi))
    limits = _best(near, k + 1).select("same", limit.alias("limit"))
    asking = asking.drop("limit").join(limits, "same")

    def visit(batches):
        for batch in batches:
            own, limits = batch.column("cell").to_numpy(), batch.column("limit").to_numpy()
            places, cells = [], []
            for at, rows_, tree in _by_width(batch, shared.value):
                if tree is None:
                    continue
                for start in range(0, len(at), 512):
                    some = at[start : start + 512]
                    near = factor * tree.bounds(rows_[start : start + 512]) <= limits[some, None] + _SLACK
                    near[np.arange(len(some)), own[some]] = False
                    query, cell = np.nonzero(near)
                    places.append(some[query])
                    cells.append(cell)
            if places:
                places, cells = np.concatenate(places), np.concatenate(cells)
                for start in range(0, len(places), 20_000):
                    going = batch.take(pa.array(places[start : start + 20_000]))
                    yield going.set_column(going.schema.get_field_index("cell"), "cell", pa.array(cells[start : start + 20_000].astype(np.int64)))

    away = asking.select("same", "width", "point", "cell", "limit").mapInArrow(visit, "same binary, width int, point binary, cell long, limit double")
    away = written(away, "search-visits")
    far = _search_shards(placed, away, shards, k, factor, id_type)
    best = written(_best(near.unionByName(far), 2 * (k + 1)), "search-best")
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = queries.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    others = F.slice(F.filter("best", lambda pair: pair["id"] != F.col("query")), 1, k)
    return (
        dealt.withColumnRenamed("id", "query").join(salted, ["same", "salt"])
        .select("query", F.posexplode(others).alias("place", "pair"))
        .select(F.col("query").alias("query_id"), (F.col("place") + 1).alias("rank"), F.col("pair.id").alias(key), (-F.col("pair.fall")).alias("score"))
    )
