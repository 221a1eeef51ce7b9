from pathlib import Path

import pytest

from creaseline.params import Params
from creaseline.plans.build import run
from creaseline.plans.sink import index_path, read_table, table_path, table_report, write_tables
from creaseline.schema import DELIVERY_COLUMNS, TABLE_COLUMNS
from creaseline.operators.lookup import lookup, lookup_one, matchup_with_fallback
from creaseline.sources.concurrent import concurrently
from creaseline.sources.storage import run_folder, shared_dir, written

PARAMS = Params(kmeans_restarts=2)


def test_empty_table_is_skipped_and_the_older_one_survives(spark, tmp_path):
    first = spark.createDataFrame([("v", 1.0)], "venue string, x double")
    assert write_tables({"venue_profiles": first}, str(tmp_path)) == ["venue_profiles"]
    assert write_tables({"venue_profiles": first.limit(0)}, str(tmp_path)) == []
    assert read_table(spark, str(tmp_path), "venue_profiles").count() == 1
    report = table_report(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in report] == [("venue_profiles", 1, "OK")]


def test_written_table_is_replaced_and_can_feed_its_own_replacement(spark, tmp_path):
    path = str(tmp_path)
    write_tables({"recent_form": spark.createDataFrame([("a", "batter")], "player string, role string")}, path)
    write_tables({"recent_form": spark.createDataFrame([("b", "batter"), ("c", "bowler")],
                                                       "player string, role string")}, path)
    assert sorted(r["player"] for r in read_table(spark, path, "recent_form").collect()) == ["b", "c"]


def test_report_marks_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "player string").write.parquet(table_path(str(tmp_path), "recent_form"))
    assert [tuple(r) for r in table_report(spark, str(tmp_path)).collect()] == [
        ("recent_form", 0, "EMPTY")]
    assert table_report(spark, str(tmp_path / "nowhere")).isEmpty()


def match_file(folder, number, bowlers):
    lines = [",".join(DELIVERY_COLUMNS)]
    for innings in (1, 2):
        for over in range(20):
            for ball in range(1, 7):
                pick = (over * 7 + ball * 3 + number * 5 + innings) % 11
                row = {
                    "match_id": str(number), "season": "2020", "venue": f"Ground {number % 2}",
                    "innings": str(innings), "ball": f"{over}.{ball}",
                    "striker": f"bat{(over + ball) % 6}", "bowler": f"bowl{over % bowlers}",
                    "runs_off_bat": str([0, 1, 4, 6, 1, 0, 2, 1, 0, 4, 1][pick]), "extras": "0",
                    "wicket_type": "caught" if pick == 5 else "",
                }
                lines.append(",".join(row.get(c, "") for c in DELIVERY_COLUMNS))
    (folder / f"{number}.csv").write_text("\n".join(lines) + "\n")
    (folder / f"{number}_info.csv").write_text(
        f"info,venue,Ground {number % 2}\ninfo,toss_decision,field\ninfo,winner,A\n"
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    matches = tmp_path_factory.mktemp("matches")
    for number in range(6):
        match_file(matches, number, 8)
    out = str(tmp_path_factory.mktemp("out"))
    return run(spark, str(matches), out, PARAMS), out


def test_run_stores_all_tables(spark, stored):
    names, out = stored
    assert names == list(TABLE_COLUMNS)
    for name in names:
        assert read_table(spark, out, name).columns == TABLE_COLUMNS[name]
    report = {r["table_name"]: r for r in table_report(spark, out).collect()}
    assert set(report) == set(TABLE_COLUMNS)
    assert all(r["status"] == "OK" for r in report.values())
    assert report["venue_profiles"]["row_count"] == 2
    venue = read_table(spark, out, "venue_profiles").filter("venue = 'Ground 0'").first()
    assert (venue["matches_played"], venue["chase_wins"]) == (3, 3)
    archetypes = read_table(spark, out, "bowler_phase_stats").select("bowling_archetype").distinct()
    assert archetypes.filter("bowling_archetype = 'unknown'").isEmpty()


def test_run_leaves_no_intermediates(spark, stored):
    folder = Path(shared_dir(spark)) / "creaseline"
    assert not list(folder.glob("run-*"))


def test_run_folder_gathers_what_threads_write_and_goes_away(spark):
    with run_folder(spark) as folder:
        frames = concurrently(spark, [lambda i=i: written(spark.range(i), "x") for i in (2, 3)])
        assert [f.count() for f in frames] == [2, 3]
        assert all(folder in name for f in frames for name in f.inputFiles())
    assert not Path(folder).exists()
    assert folder not in written(spark.range(1), "x").inputFiles()[0]


def test_single_lookup_reaches_the_scan(spark, stored):
    _, out = stored
    one = lookup_one(read_table(spark, out, "matchups_1v1"), batter="bat1", bowler="bowl2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(batter,bat1)" in plan and "EqualTo(bowler,bowl2)" in plan
    second = read_table(spark, out, "matchups_1v1", by="bowler")
    assert index_path(out, "matchups_1v1") in second.inputFiles()[0]
    key = "batter = 'bat1' AND bowler = 'bowl2'"
    assert second.filter(key).collect() == read_table(spark, out, "matchups_1v1").filter(key).collect()


def test_batch_lookup(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "player string, x int")
    requests = spark.createDataFrame([("a",), ("a",), ("z",)], "player string")
    assert sorted(map(tuple, lookup(table, requests).collect())) == [("a", 1), ("z", None)]


def test_fallback_takes_the_best_ranked_clone_that_has_a_row(spark):
    measures = ["balls_faced", "runs_scored", "dismissals", "dot_balls", "fours", "sixes",
                "strike_rate", "average", "dot_pct", "boundary_pct", "dismissal_rate_wilson_lower"]
    schema = "batter string, bowler string, " + ", ".join(f"{m} double" for m in measures)
    table = spark.createDataFrame(
        [(p, "w", *[float(x)] * len(measures)) for p, x in (("a", 1), ("c2", 2), ("c3", 3))], schema)
    clones = spark.createDataFrame(
        [("new", "c1", 0.9, 1, "batter"), ("new", "c2", 0.8, 2, "batter"),
         ("new", "c3", 0.7, 3, "batter"), ("new", "c3", 0.99, 1, "bowler")],
        "player string, clone string, similarity double, clone_rank int, role string")
    requests = spark.createDataFrame(
        [("a", "w"), ("new", "w"), ("new", "w"), ("stranger", "w")], "batter string, bowler string")
    got = {r["batter"]: r for r in matchup_with_fallback(requests, table, clones).collect()}
    assert len(got) == 3
    assert (got["a"]["source_batter"], got["a"]["similarity"], got["a"]["clone_rank"]) == ("a", 1.0, 0)
    assert (got["new"]["source_batter"], got["new"]["similarity"], got["new"]["clone_rank"],
            got["new"]["runs_scored"]) == ("c2", 0.8, 2, 2.0)
    assert got["stranger"]["source_batter"] is None and got["stranger"]["balls_faced"] is None
