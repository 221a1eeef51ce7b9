"""Near-duplicate documents by SimHash fingerprints, linked through vantage-point trees.

Fingerprints: A-Z are lower-cased, words are what stands between blanks, and the hashes of all
three-word shingles vote on 64 bits. Documents with equal fingerprints form one node.

Links: all pairs of fingerprints that differ in at most `radius` bits are found. A vantage-point
tree, built on a bounded sample, cuts the fingerprints into shards: each tree node has a vantage
fingerprint and a distance, nearer ones go left and the others right. By the triangle inequality a
pair across the cut has both ends within `radius` of that distance, so it is enough that the left
end of such a pair also visits the right side; a visitor goes on to every side that may hold a
partner. Within a shard residents are compared with each other and with visitors, in blocks. A task
returns at most one link per member, a spanning forest of the links it found: enough for the
components, and never the pairs of a dense group. Splitting stops where it would not separate.

Components: star contraction over the links, then the smallest document of each component.

Defined cases: a text without words, and a null text, has fingerprint zero and links like any other;
one or two words are one shingle; an empty table gives an empty table; repeated rows are rows of one
node; a null key never names a component unless nothing else is in it.
"""

from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.llm.components import components
from creaseline.llm.workers import shipped, slices
from creaseline.sources.storage import written

SHINGLE = 3
SEED = 42
RADIUS = 3
SHARD = 16_384  # fingerprints that a shard should hold; each further split repeats a part of them
SAMPLE = 65_536  # fingerprints, in expectation, that the tree is built on
_BLOCK = 1 << 21  # pairs compared at once
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return _majority([xxhash.xxh64_intdigest(joined, SEED)])
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *[end + 1 for end in ends[: -SHINGLE]]]
    digest = xxhash.xxh64_intdigest
    return _majority([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])])


def _majority(hashes: list[int]) -> int:
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "print") -> DataFrame:
    """`docs` with the fingerprint as a 64-bit integer in place of the text."""
    keep = [c for c in docs.columns if c not in (text, out)]
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias(out))
    schema = T.StructType([*rows.schema[:-1], T.StructField(out, T.LongType())])

    def run(batches):
        for batch in slices(batches, out):
            values = np.array([fingerprint(t) for t in batch.column(len(keep)).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], [*keep, out])

    return rows.mapInArrow(run, schema)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class VantageTree:
    """Inner nodes as lists: vantage fingerprint, cut distance, children; a child below 0 is shard -1 - child."""

    radius: int
    vantage: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    sides: list[tuple[int, int]] = field(default_factory=list)
    shards: int = 0

    @classmethod
    def build(cls, sample: np.ndarray, shard: float, radius: int) -> "VantageTree":
        """`shard` is the size, in members of the sample, below which nothing is split."""
        tree = cls(radius)
        tree.root = tree._grow(sample, sample[:0], shard, np.random.default_rng(11))
        return tree

    def _grow(self, home: np.ndarray, visit: np.ndarray, shard: float, rng) -> int:
        best = None
        if len(home) > max(shard, 8):
            for v in rng.choice(home, 8):
                d = distance(home, v)
                cut = int(np.median(d)) or 1
                near, far = d < cut, d >= cut
                crossing = (near & (d >= cut - self.radius)).sum()
                cost = crossing + abs(int(near.sum()) - int(far.sum())) / 4
                if near.any() and far.any() and (best is None or cost < best[0]):
                    best = (cost, v, cut)
        if best is not None:
            _, v, cut = best
            left, right, (lv, rv) = *self._residents(home, v, cut), self._visitors(home, visit, v, cut)
            whole = len(home) * (len(home) + len(visit))
            if len(left) * (len(left) + len(lv)) + len(right) * (len(right) + len(rv)) < 0.8 * whole:
                at = len(self.vantage)
                self.vantage.append(int(v))
                self.cut.append(cut)
                self.sides.append((0, 0))
                self.sides[at] = (self._grow(left, lv, shard, rng), self._grow(right, rv, shard, rng))
                return at
        self.shards += 1
        return -self.shards

    @staticmethod
    def _residents(home, v, cut):
        d = distance(home, v)
        return home[d < cut], home[d >= cut]

    def _visitors(self, home, visit, v, cut):
        d, e = distance(home, v), distance(visit, v).astype(int)
        return visit[e - self.radius < cut], np.concatenate([visit[e + self.radius >= cut], home[(d < cut) & (d + self.radius >= cut)]])

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, place in `prints` and residence of every copy."""
        found, open_ = [], [(self.root, np.arange(len(prints)), True)]
        while open_:
            node, at, home = open_.pop()
            if not len(at):
                continue
            if node < 0:
                found.append((np.full(len(at), -1 - node), at, np.full(len(at), home)))
                continue
            d = distance(prints[at], np.uint64(self.vantage[node])).astype(int)
            cut, (left, right) = self.cut[node], self.sides[node]
            if home:
                open_.append((left, at[d < cut], True))
                open_.append((right, at[d >= cut], True))
                open_.append((right, at[(d < cut) & (d + self.radius >= cut)], False))
            else:
                open_.append((left, at[d - self.radius < cut], False))
                open_.append((right, at[d + self.radius >= cut], False))
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int),) * 3


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n members' component."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label = label[label]


def shard_links(prints: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that a shard's residents have; residents come first in pairs."""
    order = np.argsort(~home, kind="stable")
    prints, residents = prints[order], int(home.sum())
    n = len(prints)
    a, b, held = [], [], 0
    step = max(1, _BLOCK // max(n, 1))
    for start in range(0, residents, step):
        stop = min(start + step, residents)
        near = distance(prints[start:stop, None], prints[None, start:]) <= radius
        i, j = np.nonzero(near)
        real = i < j
        a.append(i[real] + start)
        b.append(j[real] + start)
        held += len(a[-1])
        if held > 2_000_000:  # a forest says the same
            label = forest(n, np.concatenate(a), np.concatenate(b))
            tied = np.flatnonzero(label != np.arange(n))
            a, b, held = [tied], [label[tied]], len(tied)
    if not a:
        return prints[:0], prints[:0]
    label = forest(n, np.concatenate(a), np.concatenate(b))
    tied = np.flatnonzero(label != np.arange(n))
    return prints[tied], prints[label[tied]]


def print_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column `print`) that span the components."""
    total = prints.count()
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = prints if share == 1.0 else prints.filter(F.pmod(F.xxhash64("print"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = np.array([r[0] for r in drawn.select("print").collect()], dtype=np.int64).view(np.uint64)
    shared = shipped(prints.sparkSession, VantageTree.build(np.sort(sample), shard * share, radius))

    def route(batches):
        tree = shared()
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            shards, at, home = tree.route(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards.astype(np.int64)), pa.array(values[at].view(np.int64)), pa.array(home.astype(bool))],
                ["shard", "print", "home"],
            )

    def link(table):
        values = table.column("print").to_numpy().view(np.uint64)
        a, b = shard_links(values, table.column("home").to_numpy(), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = prints.select("print").mapInArrow(route, "shard long, print long, home boolean")
    return routed.groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(key, print, component_id): component_id is the smallest key reachable through links."""
    marked = written(fingerprints(docs.select(key, text), text), "prints")
    prints = written(marked.groupBy("print").agg(F.min(key).alias("first")), "distinct-prints")
    tied = written(components(print_links(prints, radius, shard)), "tied-prints")
    named = tied.join(prints, tied.node == prints.print).select("component", "print", "first")
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    renamed = named.join(smallest, "component").select("print", "smallest")
    first = written(prints.join(renamed, "print", "left").select("print", F.coalesce("smallest", "first").alias("component_id")), "print-components")
    return marked.join(first, "print").select(key, "print", "component_id")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of each component; rows without a key stay."""
    named = docs.filter(F.col(key).isNotNull())
    found = near_duplicates(named, key, text)
    staying = written(found.filter(F.col(key) == F.col("component_id")).select(key).distinct(), "staying")
    kept = named.join(staying, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.filter(F.col(key).isNull()))
