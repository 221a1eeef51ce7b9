import numpy as np
import pytest

from creaseline.operators import clones
from creaseline.operators.neighbours import best_of_block, median_planes, nearest


def brute_force(vectors, k):
    """All pairs of one role, ranked by (falling similarity, name)."""
    names = sorted(vectors)
    found = set()
    for name in names:
        others = [
            (-round(float(np.dot(vectors[name], vectors[o])), 12), o) for o in names if o != name
        ]
        for rank, (fall, other) in enumerate(sorted(others)[:k], start=1):
            if -fall > 0:
                found.add((name, other, round(-fall, 4), rank))
    return found


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def as_frame(spark, people, role):
    rows = [(role, name, [float(x) for x in v]) for name, v in people.items()]
    return spark.createDataFrame(rows, "role string, player string, unit array<double>")


def search(spark, people, k, leaf_size):
    found = nearest(as_frame(spark, people, "batter"), k, leaf_size).collect()
    assert {r["role"] for r in found} <= {"batter"}
    return {(r["player"], r["clone"], r["similarity"], r["clone_rank"]) for r in found}


@pytest.mark.parametrize("leaf_size", [4, 2048])
def test_exact_with_copies_clusters_and_far_points(spark, leaf_size):
    rng = np.random.default_rng(3)
    spread = unit(rng.normal(size=(120, 5)))
    cluster = unit(np.array([1.0, 0, 0, 0, 0]) + rng.normal(scale=1e-3, size=(60, 5)))
    copies = np.repeat(spread[:1], 70, axis=0)
    lonely = np.array([[0, 0, 0, 0, -1.0]])
    points = np.vstack([spread, cluster, copies, lonely])
    order = rng.permutation(len(points))
    people = {f"p{i:03d}": points[j] for i, j in enumerate(order)}
    assert search(spark, people, 3, leaf_size) == brute_force(people, 3)


def test_large_leaf_is_split_into_blocks(spark, monkeypatch):
    from creaseline.operators import neighbours

    monkeypatch.setattr(neighbours, "MAX_LEAVES", 4)
    people = {f"p{i:03d}": v for i, v in
              enumerate(unit(np.random.default_rng(8).normal(size=(150, 3))))}
    assert search(spark, people, 2, 5) == brute_force(people, 2)


def test_roles_are_searched_apart(spark):
    rng = np.random.default_rng(4)
    batters = {f"b{i}": v for i, v in enumerate(unit(rng.normal(size=(20, 7))))}
    bowlers = {f"b{i}": v for i, v in enumerate(unit(rng.normal(size=(30, 6))))}
    both = as_frame(spark, batters, "batter").union(as_frame(spark, bowlers, "bowler"))
    for leaf_size in (8, 2048):
        rows = nearest(both, 3, leaf_size).collect()
        for role, people in (("batter", batters), ("bowler", bowlers)):
            got = {(r["player"], r["clone"], r["similarity"], r["clone_rank"])
                   for r in rows if r["role"] == role}
            assert got == brute_force(people, 3)


def test_opposites_and_single_players_have_no_clone(spark):
    assert search(spark, {"a": [1.0, 0.0], "b": [-1.0, 0.0]}, 3, 2048) == set()
    assert search(spark, {"a": [1.0, 0.0]}, 3, 2048) == set()


def test_planes_put_every_point_into_a_leaf():
    points = unit(np.random.default_rng(1).normal(size=(500, 4)))
    leaves = median_planes(points, 4).leaf_of(points)
    assert leaves.min() >= 0 and leaves.max() < 16
    assert np.bincount(leaves, minlength=16).max() <= 40


def test_best_of_block_settles_ties_by_row():
    query, row, score = best_of_block(np.array([[1.0, 0.0]]), np.array([[0, 1.0], [1, 0], [1, 0]]), 1)
    assert (query.tolist(), row.tolist(), score.tolist()) == ([0], [1], [1.0])


def test_features_and_zero_spread(spark, make_fact):
    rows = [{"striker": s, "bowler": "w", "ball": ball, "runs_off_bat": runs}
            for s, runs in (("a", 1.0), ("b", 2.0), ("c", 0.0)) for ball in ("1.1", "8.1")
            for _ in range(10)]
    rows += [{"striker": "few", "bowler": "w"}] * 19
    features = clones.clone_features(make_fact(rows), "batter")
    got = {r["player"]: r for r in features.collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["sr"], got["a"]["average"], got["a"]["pp_sr"], got["a"]["death_sr"]) == (
        100.0, 20.0, 100.0, 0.0)
    z = clones.standardised(features, clones.BATTER_FEATURES, "batter").collect()
    assert all(r["z"][clones.BATTER_FEATURES.index("death_sr")] == 0.0 for r in z)


def test_player_at_the_mean_is_left_out(spark):
    features = spark.createDataFrame(
        [("a", 1.0, 5.0), ("b", 3.0, 9.0), ("mean", 2.0, 7.0)], "player string, x double, y double"
    )
    units = clones.unit_vectors(features, ["x", "y"], "batter")
    assert sorted(r["player"] for r in units.collect()) == ["a", "b"]
