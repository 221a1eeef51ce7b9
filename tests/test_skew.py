"""Plans and results with one key that holds most of the rows."""

import re

import pytest

from conftest import SMALL
from creaseline.catalogue.queries import QUERIES
from creaseline.operators import form, matchups, phases, pressure, venues
from creaseline.operators.rollups import bowler_phase_rollup, match_rollup, pair_rollup

LAZY = sorted(set(QUERIES) - {
    "table_report", "bowling_archetypes", "matchup_with_fallback", "ingest_deliveries",
    "table_lookup", "player_clones", "bowling_archetype_join",
})


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_row_code(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not re.search("CartesianProduct|BroadcastNestedLoop|Python", text)


@pytest.fixture(scope="module")
def hot(make_fact):
    """One pair in one match holds more than half of the deliveries."""
    rows = [{"match_id": "hot", "striker": "hot", "bowler": "hot", "runs_off_bat": 1.0,
             "ball": f"{i % 20}.1", "innings": 1 + i % 2} for i in range(3000)]
    rows += [{"match_id": f"m{i % 50}", "striker": f"s{i % 7}", "bowler": f"w{i % 9}",
              "ball": f"{i % 20}.1", "innings": 1 + i % 2, "runs_off_bat": float(i % 5)}
             for i in range(2000)]
    return make_fact(rows).repartition(8).cache()


@pytest.mark.parametrize("rollup,keys", [
    (pair_rollup, ["striker", "bowler"]), (bowler_phase_rollup, ["bowler", "phase"]),
    (match_rollup, ["match_id", "venue"]),
])
def test_rollups_combine_before_the_shuffle(hot, rollup, keys):
    text = plan(rollup(hot))
    assert text.count("Exchange hashpartitioning") == 1
    below = text[text.index("Exchange hashpartitioning"):]
    assert re.search(r"HashAggregate.*partial_", below)


def test_results_with_a_hot_key_are_whole(hot):
    pair = matchups.matchups(hot).filter("batter = 'hot'").first()
    assert (pair["balls_faced"], pair["runs_scored"]) == (3000, 3000.0)
    bowled = phases.bowler_phase(hot).filter("bowler = 'hot'").collect()
    assert sum(r["balls_bowled"] for r in bowled) == 3000
    late = pressure.pressure(hot).filter("player = 'hot'").collect()
    assert {r["role"] for r in late} == {"batter", "bowler"}
    assert {r["balls_faced"] for r in late} == {300}
    assert venues.innings_totals(hot).filter("match_id = 'hot'").count() == 2
    assert form.recent_form(hot).filter("player = 'hot'").count() == 2


def test_style_join_meets_pair_sums_not_deliveries(hot):
    text = plan(matchups.batter_vs_style(hot))
    join = re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin).*", text)
    assert "HashAggregate" in text[join.start():].split("Exchange")[0]
