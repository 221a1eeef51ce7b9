import random

from pyspark.sql import functions as F

from creaseline.operators import archetypes
from creaseline.params import Params
from creaseline.schema import TABLE_COLUMNS

_SCHEMA = (
    "bowler string, phase string, runs_conceded double, balls_bowled bigint, wickets bigint,"
    " dot_balls bigint, fours_conceded bigint, sixes_conceded bigint, economy double,"
    " bowling_sr double, average double, dot_pct double, boundary_concede_pct double"
)


def phase_stats(spark, bowlers, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(bowlers):
        for phase in ("powerplay", "middle", "death"):
            base = 4 + 3 * (i % 5)
            rows.append((f"w{i:02d}", phase, 100.0, 60, 3, 20, 4, 2,
                         round(base + rng.random(), 2), round(15 + 4 * (i % 5) + rng.random(), 2),
                         30.0, round(30 + 5 * (i % 5) + rng.random(), 2), 8.0))
    return spark.createDataFrame(rows, _SCHEMA)


def test_too_few_bowlers_are_unknown(spark):
    table = archetypes.with_archetypes(phase_stats(spark, 4))
    assert {r["bowling_archetype"] for r in table.collect()} == {"unknown"}


def test_every_bowler_gets_one_of_the_labels(spark):
    stats = phase_stats(spark, 40)
    params = Params(kmeans_restarts=4)
    table = archetypes.with_archetypes(stats, params)
    assert table.columns == TABLE_COLUMNS["bowler_phase_stats"]
    rows = table.collect()
    assert len(rows) == 120
    label = {}
    for row in rows:
        assert label.setdefault(row["bowler"], row["bowling_archetype"]) == row["bowling_archetype"]
    groups = {}
    for name, archetype in label.items():
        groups.setdefault(archetype, set()).add(int(name[1:]) % 5)
    # Five well-separated groups: every cluster is one of them, the cheapest claims first.
    assert sorted(len(g) for g in groups.values()) == [1] * 5
    assert groups["death_specialist"] == {0}
    assert groups["powerplay_enforcer"] == {1}

    again = archetypes.archetypes(stats.repartition(7), params).collect()
    assert {r["bowler"]: r["bowling_archetype"] for r in again} == label


def test_features_of_a_bowler_without_death_overs_or_wickets(spark):
    stats = phase_stats(spark, 1).filter("phase != 'death'").drop("bowling_sr").selectExpr(
        "*", "999D AS bowling_sr"
    )
    row = archetypes.archetype_features(stats).first()
    assert (row["c_death_econ"], row["c_bowl_sr"]) == (0.0, 999.0)
    assert row["c_pp_econ"] > 0


def test_claims_go_to_the_lowest_free_cluster():
    centroid = dict(c_economy=5.0, c_dot_pct=40.0, c_bowl_sr=20.0, c_death_econ=0.0, c_pp_econ=6.0)
    centroids = [
        {**centroid, "c_death_econ": 9.0, "c_economy": 4.0},
        {**centroid},
        {**centroid, "c_death_econ": 8.0, "c_pp_econ": 7.0, "c_bowl_sr": 10.0},
        {**centroid, "c_death_econ": 8.0, "c_pp_econ": 5.0},
        {**centroid, "c_death_econ": 8.5, "c_economy": 6.0},
    ]
    assert archetypes.label_clusters(centroids) == [
        "economy_merchant", "death_specialist", "strike_bowler", "powerplay_enforcer", "allrounder"]
    assert archetypes.label_clusters(centroids[:1]) == ["death_specialist"]


def test_labels_do_not_depend_on_partitions_and_are_a_fixed_point(spark):
    rng = random.Random(3)
    stats = phase_stats(spark, 40).withColumn("economy", F.expr("economy + 3 * rand(5)")).withColumn(
        "dot_pct", F.expr("dot_pct + 20 * rand(6)")).collect()
    rng.shuffle(stats)
    params = Params(kmeans_restarts=6)
    labels = []
    for n in (1, 3, 8):
        frame = spark.createDataFrame(stats, _SCHEMA).repartition(n)
        found = archetypes.archetypes(frame, params)
        labels.append({r["bowler"]: r["bowling_archetype"] for r in found.collect()})
        checked = archetypes.archetype_check(archetypes.archetype_features(frame), found).collect()
        assert len(checked) == 40
        assert all(r["nearest_is_own"] and r["claim_holds"] for r in checked)
    assert labels[0] == labels[1] == labels[2]
    swapped = spark.createDataFrame(
        [(b, "death_specialist" if i % 2 else name) for i, (b, name) in enumerate(labels[0].items())], "bowler string, bowling_archetype string")
    checked = archetypes.archetype_check(archetypes.archetype_features(frame), swapped).collect()
    assert not all(r["nearest_is_own"] for r in checked)
