"""Connected components of a link table by alternating star contraction.

Large star: every neighbour larger than a node links to the smallest node around it. Small star:
every smaller neighbour, and the node itself, links to the smallest of them. The two alternate until
each component is one star around its smallest node; the number of rounds grows with the logarithm
of the number of nodes. Only joins and aggregates; each round is written, so none is recomputed, and
a node with very many links is an ordinary skewed join key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.sources.storage import forget, written_alone


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest node.

    Links with a null end and links of a node to itself say nothing; repeated links count once.
    """
    edges = written_alone(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if now == state or now[0] == 0:
            break
        state = now
        last, edges = edges, written_alone(_small_star(_large_star(edges)), "links")
        forget(last)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least).distinct()
