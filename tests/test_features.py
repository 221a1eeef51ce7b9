def flags(make_fact, **row):
    return make_fact([row]).first()


def test_over_and_phase_edges(make_fact):
    cases = {
        "0.1": (0, "powerplay"), "5.6": (5, "powerplay"), "6.1": (6, "middle"),
        "14.6": (14, "middle"), "15.1": (15, "death"), "100.1": (100, "death"),
        "101.1": (101, "nan"), "-1.2": (-1, "nan"), "junk": (0, "powerplay"),
        "": (0, "powerplay"), None: (0, "powerplay"), " 7.1": (7, "middle"),
        "1e1.2": (10, "middle"), "5d.1": (0, "powerplay"), "9999999999.1": (2147483647, "nan"),
    }
    rows = make_fact([{"ball": ball} for ball in cases]).collect()
    assert {r["ball"]: (r["over_int"], r["phase"]) for r in rows} == cases


def test_wides_are_not_legal_but_noballs_are(make_fact):
    wide = flags(make_fact, wides=1.0, extras=1.0, runs_off_bat=4.0)
    assert (wide["is_wide"], wide["is_legal"], wide["is_boundary4"], wide["is_dot"]) == (
        True, False, False, False)
    noball = flags(make_fact, noballs=1.0, extras=1.0, runs_off_bat=6.0)
    assert (noball["is_noball"], noball["is_legal"], noball["is_boundary6"]) == (True, True, True)


def test_runs_conceded_takes_byes_and_leaves_penalties(make_fact):
    row = flags(make_fact, runs_off_bat=1.0, byes=2.0, legbyes=3.0, noballs=1.0, penalty=5.0,
                extras=11.0)
    assert row["runs_conceded"] == 7.0
    assert not row["is_dot"]


def test_dot_needs_no_extras(make_fact):
    assert flags(make_fact)["is_dot"]
    assert not flags(make_fact, legbyes=1.0, extras=1.0)["is_dot"]


def test_wickets(make_fact):
    cases = {
        "": (False, False), "  ": (False, False), " ": (False, False),
        "caught": (True, True), "run out": (True, False), "run out ": (True, True),
        "retired hurt": (True, True), "timed out": (True, False), None: (False, False),
    }
    for kind, expected in cases.items():
        row = flags(make_fact, wicket_type=kind)
        assert (row["is_wicket"], bool(row["is_batter_out"])) == expected, kind
