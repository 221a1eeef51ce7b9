import random

from creaseline.operators.form import (
    batter_matches, bowler_matches, last_batter_matches, last_bowler_matches, recent_form,
)
from creaseline.params import Params
from creaseline.schema import TABLE_COLUMNS


def trend(values, better, worse):
    if len(values) < 4:
        return "stable"
    mid = len(values) // 2
    early, late = sum(values[:mid]) / mid, sum(values[mid:]) / (len(values) - mid)
    return "improving" if better(late, early) else "declining" if worse(late, early) else "stable"


def test_against_a_direct_computation(spark, make_fact):
    rng = random.Random(11)
    ids = ["9", "10", "100", "335982", "1082591", "7", "8", "77", "a1", "B2", "3", "31", "32"]
    rows = []
    for match in ids:
        for _ in range(rng.randrange(20, 60)):
            wide = rng.random() < 0.1
            rows.append({
                "match_id": match, "striker": rng.choice("pqrs"), "bowler": rng.choice("wxyz"),
                "runs_off_bat": float(rng.choice([0, 0, 1, 4, 6])), "wides": float(wide),
                "extras": float(wide), "wicket_type": rng.choice(["", "", "", "", "caught"]),
            })
    params = Params(form_matches=8)
    table = recent_form(make_fact(rows), params)
    assert table.columns == TABLE_COLUMNS["recent_form"]
    got = {(r["player"], r["role"]): r for r in table.collect()}
    assert len(got) == 8
    for player in "pqrs":
        played = sorted({r["match_id"] for r in rows if r["striker"] == player and not r["wides"]})
        runs, rates, outs = [], [], []
        for match in played[-8:]:
            legal = [r for r in rows
                     if r["match_id"] == match and r["striker"] == player and not r["wides"]]
            runs.append(sum(r["runs_off_bat"] for r in legal))
            rates.append(runs[-1] * 100 / len(legal))
            outs.append(sum(r["wicket_type"] != "" for r in legal))
        row = got[(player, "batter")]
        assert row["recent_avg_runs"] == round(sum(runs) / len(runs), 2)
        assert row["recent_avg_sr"] == round(sum(rates) / len(rates), 2)
        assert row["recent_dismissal_rate"] == round(sum(outs) / len(outs), 3)
        assert row["recent_economy"] is None and row["recent_wickets_per_match"] is None
        assert row["form_trend"] == trend(
            runs, lambda a, b: a > b * 1.15, lambda a, b: a < b * 0.85)
        assert row["sample_matches"] == len(runs)
    for player in "wxyz":
        played = sorted({r["match_id"] for r in rows if r["bowler"] == player})
        economy, wickets = [], []
        for match in played[-8:]:
            own = [r for r in rows if r["match_id"] == match and r["bowler"] == player]
            legal = sum(not r["wides"] for r in own)
            conceded = sum(r["runs_off_bat"] + r["wides"] for r in own)
            economy.append(conceded * 6 / legal if legal else 0.0)
            wickets.append(sum(r["wicket_type"] != "" for r in own))
        row = got[(player, "bowler")]
        assert row["recent_economy"] == round(sum(economy) / len(economy), 2)
        assert row["recent_wickets_per_match"] == round(sum(wickets) / len(wickets), 3)
        assert row["form_trend"] == trend(
            economy, lambda a, b: a < b * 0.9, lambda a, b: a > b * 1.1)


def test_last_matches_are_limited_before_the_shuffle(make_fact):
    plan = recent_form(make_fact([{}]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_short_series_is_stable(make_fact):
    rows = [{"match_id": str(i), "runs_off_bat": float(i * 6)} for i in range(3)]
    assert {r["form_trend"] for r in recent_form(make_fact(rows)).collect()} == {"stable"}


def test_only_late_matches_are_summed(spark, make_fact):
    rng = random.Random(5)
    ids = [str(n) for n in range(300)] + [f"2019-final-{n}" for n in range(300)] + ["é", "\U0001F3CF", "", "2019-final"]
    # Wides alone make no match of a batter; 'rare' has fewer matches than are asked for.
    rows = [{"match_id": match, "striker": rng.choice("pq"), "bowler": rng.choice("wx"), "runs_off_bat": float(n % 7),
             "wides": float(n % 3 == 0)} for match in ids for n in range(4)]
    rows += [{"match_id": str(n), "striker": "rare", "bowler": "seldom", "runs_off_bat": float(n)} for n in range(3)]
    fact = make_fact(rows)
    for last, every in ((last_batter_matches, batter_matches), (last_bowler_matches, bowler_matches)):
        whole = {(row["player"], row["match_id"]): row for row in every(fact).collect()}
        kept = {(row["player"], row["match_id"]): row for row in last(fact, Params(form_matches=2)).collect()}
        assert all(whole[key] == row for key, row in kept.items())
        for player in {player for player, _ in whole}:
            own = sorted((match for p, match in whole if p == player), key=str.encode)
            assert all((player, match) in kept for match in own[-2:])
        assert len(kept) < len(whole) / 2
