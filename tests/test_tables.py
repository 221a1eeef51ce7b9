import pytest

from creaseline.operators import matchups, phases, pressure, styles, summary, venues
from creaseline.operators.rollups import match_rollup
from creaseline.params import Params
from creaseline.schema import TABLE_COLUMNS


def balls(n, **row):
    return [dict(row) for _ in range(n)]


def by(frame, *keys):
    return {tuple(r[k] for k in keys): r for r in frame.collect()}


def test_matchups_threshold_and_metrics(make_fact):
    rows = (
        balls(5, striker="a", bowler="x", runs_off_bat=1.0)
        + balls(6, striker="b", bowler="x", runs_off_bat=4.0)
        + balls(3, striker="b", bowler="x", wides=1.0, extras=1.0)
        + balls(24, striker="c", bowler="x")
        + balls(1, striker="c", bowler="x", wicket_type="bowled")
    )
    table = matchups.matchups(make_fact(rows))
    assert table.columns == TABLE_COLUMNS["matchups_1v1"]
    got = by(table, "batter")
    assert set(got) == {("b",), ("c",)}
    b, c = got[("b",)], got[("c",)]
    assert (b["balls_faced"], b["runs_scored"], b["strike_rate"], b["average"]) == (
        6, 24.0, 400.0, 24.0)
    assert (b["boundary_pct"], b["dismissal_rate_wilson_lower"]) == (100.0, 0.0)
    assert (c["dismissals"], c["dismissal_rate_wilson_lower"], c["dot_pct"]) == (1, 0.0071, 100.0)


def test_rows_without_a_key_are_dropped(make_fact):
    rows = balls(40, striker=None) + balls(40, bowler=None)
    fact = make_fact(rows)
    assert matchups.matchups(fact).isEmpty()
    assert [r["batter"] for r in matchups.batter_phase(fact).collect()] == ["bat"]
    assert [r["bowler"] for r in phases.bowler_phase(fact).collect()] == ["bowl"]


def test_bowler_phase_counts_runs_of_wides_and_legal_wickets_only(make_fact):
    rows = (
        balls(30, runs_off_bat=1.0)
        + balls(10, wides=2.0, extras=2.0, wicket_type="stumped")
        + balls(40, bowler="wide only", wides=1.0, extras=1.0)
    )
    table = phases.bowler_phase(make_fact(rows), Params(bowler_balls=0))
    got = by(table, "bowler")
    assert set(got) == {("bowl",)}
    row = got[("bowl",)]
    assert (row["runs_conceded"], row["balls_bowled"], row["wickets"]) == (50.0, 30, 0)
    assert (row["economy"], row["bowling_sr"], row["average"]) == (10.0, 999.0, 999.0)


def test_phase_outside_all_bins_is_a_group_of_its_own(make_fact):
    got = by(matchups.batter_phase(make_fact(balls(30, ball="101.1"))), "phase")
    assert set(got) == {("nan",)}


def test_style_rule(make_fact):
    rows = (
        # 10 opening balls of 60: 17 percent; middle overs half dots and cheap.
        balls(10, bowler="slow", ball="1.1", runs_off_bat=1.0)
        + balls(25, bowler="slow", ball="8.1") + balls(25, bowler="slow", ball="9.1",
                                                       runs_off_bat=1.0)
        + balls(40, bowler="quick", ball="1.1")
        + balls(29, bowler="new", ball="8.1")
        + balls(5, bowler="wide only", wides=1.0)
    )
    fact = make_fact(rows)
    known = styles.bowler_styles(fact)
    assert {k[0]: r["bowling_style"] for k, r in by(known, "bowler").items()} == {
        "slow": "spin", "quick": "pace", "new": "unknown"}
    styled = styles.attach_styles(fact, known).groupBy("bowling_style").count()
    assert {r["bowling_style"]: r["count"] for r in styled.collect()} == {
        "spin": 60, "pace": 40, "unknown": 34}


def test_balls_of_an_unnamed_bowler_count_as_unknown_style(make_fact):
    table = matchups.batter_vs_style(make_fact(balls(30, bowler=None)))
    assert [(r["bowling_style"], r["balls_faced"]) for r in table.collect()] == [("unknown", 30)]


def venue_rows():
    return (
        balls(18, match_id="m1", runs_off_bat=1.0)
        + balls(6, match_id="m1", ball="7.1", runs_off_bat=2.0)
        + balls(18, match_id="m2", runs_off_bat=2.0)
        + balls(10, match_id="m2", innings=2, runs_off_bat=3.0)
        + balls(4, match_id="m2", innings=3, runs_off_bat=6.0)
        + balls(9, match_id="m3", venue="W", innings=2)
        + balls(2, match_id="m4", venue="X", wides=1.0, extras=1.0)
        + balls(5, match_id="m5", venue=None)
    )


def test_venue_profiles(spark, make_fact):
    info = spark.createDataFrame(
        [("V", "field", ""), ("V", "field", "A"), ("V", "bat", "A"), ("W", "field", "B")],
        "venue string, toss_decision string, winner string",
    )
    table = venues.venue_profiles(make_fact(venue_rows()), info)
    assert table.columns == TABLE_COLUMNS["venue_profiles"]
    got = by(table, "venue")
    assert set(got) == {("V",), ("X",)}
    v = got[("V",)]
    assert (v["avg_first_innings_score"], v["matches_played"], v["avg_second_innings_score"]) == (
        33.0, 2, 30.0)
    assert (v["avg_powerplay_runs"], v["avg_middle_runs"], v["avg_death_runs"]) == (27.0, 12.0, 0.0)
    assert (v["chase_wins"], v["total_tosses"]) == (2, 2)
    x = got[("X",)]
    # No legal early ball: 2 runs over the stand-in of 18 balls; medians 9.0 of (6, 12) and 6.0.
    assert x["surface_behavior_index"] == round(2 * 6 / 18 / 6.0, 3)
    assert v["surface_behavior_index"] == 1.5
    assert x["avg_second_innings_score"] is None and x["chase_wins"] == 0


def test_venue_profiles_without_match_information(make_fact):
    table = venues.venue_profiles(make_fact(venue_rows()))
    assert table.columns == TABLE_COLUMNS["venue_profiles"][:-2]


def test_surface_index_is_neutral_without_early_balls(make_fact):
    table = venues.venue_profiles(make_fact(balls(6, ball="9.1", runs_off_bat=1.0)))
    assert table.first()["surface_behavior_index"] == 1.0


def test_pressure_uses_first_innings_total_and_both_roles(make_fact):
    chase = dict(innings=2, ball="17.1")
    rows = (
        balls(30, match_id="big", runs_off_bat=6.0)
        + balls(6, match_id="big", striker="s", bowler="w", runs_off_bat=1.0, byes=1.0,
                extras=1.0, wicket_type="run out", **chase)
        + balls(2, match_id="big", striker="s", bowler="w", wides=1.0, extras=1.0, **chase)
        + balls(9, match_id="big", striker="early", bowler="w", innings=2, ball="15.6")
        + balls(27, match_id="small", runs_off_bat=6.0)
        + balls(9, match_id="small", striker="s", bowler="w", **chase)
        + balls(3, match_id="big", striker=None, bowler="w", **chase)
    )
    table = pressure.pressure(make_fact(rows))
    assert table.columns == TABLE_COLUMNS["pressure_performance"]
    got = by(table, "player", "role")
    assert set(got) == {("s", "batter"), ("w", "bowler")}
    s, w = got[("s", "batter")], got[("w", "bowler")]
    assert (s["balls_faced"], s["runs_scored"], s["dismissals"]) == (6, 6.0, 0)
    assert (w["balls_faced"], w["runs_scored"], w["dismissals"]) == (9, 12.0, 6)
    assert s["pressure_scenario"] == "inn2_over16+_target>=165"


def test_pressure_total_itself_qualifies(make_fact):
    rows = balls(165, runs_off_bat=1.0)
    assert pressure.pressure_matches(make_fact(rows)).first()["fi_score"] == 165.0
    assert pressure.pressure_matches(make_fact(rows[1:])).isEmpty()


def test_summaries(make_fact):
    fact = make_fact(
        balls(3, season="2021", match_id="a") + balls(2, season="2020", match_id="b", ball="101.1",
                                                      wides=1.0) + balls(1, season=None)
    )
    load = summary.load_summary(fact).first()
    assert (load["deliveries"], load["matches"], load["seasons"]) == (6, 3, ["2020", "2021"])
    features = summary.feature_summary(fact).first()
    assert (features["legal_deliveries"], features["powerplay_deliveries"],
            features["no_phase_deliveries"]) == (4, 4, 2)


def test_results_do_not_depend_on_row_order_or_partitions(spark, make_fact):
    fact = make_fact(venue_rows() * 2)
    shuffled = fact.repartition(7).orderBy("ball")
    for build in (match_rollup, matchups.matchups, venues.venue_profiles):
        assert sorted(map(str, build(fact).collect())) == sorted(map(str, build(shuffled).collect()))


@pytest.mark.parametrize("role,total", [("batter", 80), ("bowler", 80)])
def test_phase_balls_add_up_to_all_balls(make_fact, role, total):
    rows = balls(40, ball="3.1") + balls(40, ball="12.1")
    build = matchups.batter_phase if role == "batter" else phases.bowler_phase
    count = "balls_faced" if role == "batter" else "balls_bowled"
    assert sum(r[count] for r in build(make_fact(rows)).collect()) == total
