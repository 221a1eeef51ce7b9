"""Bowler archetypes: K-Means over career features, clusters named by their centroids."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.functions import double
from creaseline.operators.clones import standardised
from creaseline.operators.kmeans import SCALE, best_centres, nearest_centres, points_of, whole_points
from creaseline.operators.phases import NO_WICKET
from creaseline.operators.rollups import summed
from creaseline.params import Params
from creaseline.schema import TABLE_COLUMNS
from creaseline.sources.storage import written

FEATURES = ["c_economy", "c_dot_pct", "c_bowl_sr", "c_death_econ", "c_pp_econ"]

# The cluster lowest in a feature takes the label, in this order; the rest share one.
CLAIMS = [
    ("c_death_econ", "death_specialist"),
    ("c_pp_econ", "powerplay_enforcer"),
    ("c_bowl_sr", "strike_bowler"),
    ("c_economy", "economy_merchant"),
]
OTHER_LABEL = "allrounder"
NO_LABEL = "unknown"


def archetype_features(phase_stats: DataFrame) -> DataFrame:
    """Plain means over a bowler's retained, already rounded phase rows."""
    def economy_in(phase):
        return f"coalesce(avg(economy) FILTER (WHERE phase = '{phase}'), 0D)"

    without_wicket = double(NO_WICKET)
    strike = f"avg(bowling_sr) FILTER (WHERE bowling_sr < {without_wicket})"
    return summed(phase_stats, ["bowler"], [
        "avg(economy) AS c_economy",
        "avg(dot_pct) AS c_dot_pct",
        f"coalesce({strike}, {without_wicket}) AS c_bowl_sr",
        f"{economy_in('death')} AS c_death_econ",
        f"{economy_in('powerplay')} AS c_pp_econ",
    ])


def label_clusters(centroids: list[dict[str, float]]) -> list[str]:
    """Name each cluster; every claim takes the lowest cluster still free, ties by number."""
    labels: dict[int, str] = {}
    for feature, label in CLAIMS:
        free = [c for c in range(len(centroids)) if c not in labels]
        if free:
            labels[min(free, key=lambda c: (centroids[c][feature], c))] = label
    return [labels.get(c, OTHER_LABEL) for c in range(len(centroids))]


def archetypes(phase_stats: DataFrame, params: Params = Params()) -> DataFrame:
    """(bowler, bowling_archetype). Runs jobs: the clustering is fitted here.

    The best of several seeded starts is kept. All starts run side by side, one job for each seed
    drawn and each Lloyd step; their sums are whole numbers, so the layout of rows does not matter.
    """
    career = written(archetype_features(phase_stats), "career")
    if career.count() < params.archetypes:
        return career.select("bowler", F.lit(NO_LABEL).alias("bowling_archetype"))
    scaled = standardised(career.withColumnRenamed("bowler", "player"), FEATURES, "bowler")
    points = written(scaled.select("player", whole_points("z").alias("point")), "scaled")
    centres = best_centres(points, params)
    moments = summed(career, [], [
        *[f"avg({name}) AS {name}_mean" for name in FEATURES],
        *[f"stddev_pop({name}) AS {name}_std" for name in FEATURES],
    ]).first()
    centroids = [
        {
            name: float(centre[i]) / SCALE * moments[f"{name}_std"] + moments[f"{name}_mean"]
            for i, name in enumerate(FEATURES)
        }
        for centre in centres
    ]
    names = np.array(label_clusters(centroids))

    def label(batches):
        for batch in batches:
            chosen = names[nearest_centres(points_of(batch), centres[None])[:, 0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("player"), pa.array(chosen, pa.string())], ["bowler", "bowling_archetype"]
            )

    return points.mapInArrow(label, "bowler string, bowling_archetype string")


def archetype_check(career: DataFrame, labels: DataFrame) -> DataFrame:
    """(bowler, nearest_is_own, claim_holds): whether the labels are a fixed point of the clustering.

    For up to five archetypes, where no two share a label. A bowler's own archetype must have the nearest mean of all archetypes, and each claim must have
    gone to the archetype lowest in its feature among those not claimed before.
    """
    scaled = standardised(career.withColumnRenamed("bowler", "player"), FEATURES, "bowler")
    joined = scaled.selectExpr("player AS bowler", "z").join(labels, "bowler").join(career, "bowler")
    rows = written(joined, "labelled")
    means = summed(rows, ["bowling_archetype"], [
        f"array({', '.join(f'avg(z[{i}])' for i in range(len(FEATURES)))}) AS centre",
        *[f"avg({name}) AS {name}" for name in FEATURES],
    ]).withColumnRenamed("bowling_archetype", "name")
    order = {label: place for place, (_, label) in enumerate(CLAIMS)}
    feature = {label: name for name, label in CLAIMS}
    place = F.coalesce(*[F.when(F.col("name") == n, F.lit(p)) for n, p in order.items()], F.lit(len(CLAIMS)))
    means = means.withColumn("place", place)
    # One row per archetype by construction, so all of them fit in an array.
    # A constant key would be folded away and leave a cross join, so the key is the width of the vectors.
    every = means.groupBy(F.size("centre").alias("width")).agg(F.collect_list(F.struct("name", "place", "centre", *FEATURES)).alias("every"))
    apart = "aggregate(zip_with(z, m.centre, (x, y) -> (x - y) * (x - y)), 0D, (total, x) -> total + x)"
    own = "element_at(filter(every, m -> m.name = bowling_archetype), 1)"
    claims = " ".join(
        f"WHEN '{label}' THEN forall(every, m -> m.place < {order[label]} OR {own}.{feature[label]} <= m.{feature[label]} + 1e-6)"
        for label in order
    )
    return rows.withColumn("width", F.size("z")).join(F.broadcast(every), "width").selectExpr(
        "bowler",
        f"array_min(transform(every, m -> {apart})) + 1e-6 >= transform(filter(every, m -> m.name = bowling_archetype), m -> {apart})[0]"
        " AS nearest_is_own",
        f"CASE bowling_archetype {claims} ELSE true END AS claim_holds",
    )


def attach_archetypes(phase_stats: DataFrame, labels: DataFrame) -> DataFrame:
    return (
        phase_stats.join(labels, "bowler", "left")
        .fillna(NO_LABEL, "bowling_archetype")
        .select(*TABLE_COLUMNS["bowler_phase_stats"])
    )


def with_archetypes(phase_stats: DataFrame, params: Params = Params()) -> DataFrame:
    """The complete bowler_phase_stats table."""
    phase_stats = written(phase_stats, "bowler-phase")
    return attach_archetypes(phase_stats, archetypes(phase_stats, params))
