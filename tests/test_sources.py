from itertools import product

import pytest
from pyspark.sql import functions as F

from creaseline.catalogue import queries
from creaseline.schema import DELIVERY_COLUMNS
from creaseline.sources import deliveries
from creaseline.sources.deliveries import read_deliveries
from creaseline.sources.match_info import _fields, read_match_info
from creaseline.sources.storage import written

HEADER = ",".join(DELIVERY_COLUMNS)


def line(**values):
    base = {"match_id": "1", "season": "2020", "venue": "V", "innings": "1", "ball": "0.1",
            "striker": "s", "bowler": "b", "runs_off_bat": "0", "extras": "0"}
    return ",".join({**base, **values}.get(name, "") for name in DELIVERY_COLUMNS)


def write(folder, name, *lines, end="\n"):
    (folder / name).write_bytes(
        b"".join((x if isinstance(x, bytes) else x.encode()) + end.encode() for x in lines)
    )


def load(spark, folder):
    return read_deliveries(spark, str(folder))


def rows_by_match(source):
    out = {}
    for row in source.deliveries.collect():
        out.setdefault(row["match_id"], []).append(row)
    return out


def test_no_delivery_file_is_an_error(spark, tmp_path):
    write(tmp_path, "1_info.csv", "info,venue,V")
    with pytest.raises(FileNotFoundError):
        load(spark, tmp_path)


def test_nothing_loaded_is_an_error(spark, tmp_path):
    write(tmp_path, "1.csv", HEADER, line() + ",extra")
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        load(spark, tmp_path)


def test_only_empty_files_is_an_error(spark, tmp_path):
    write(tmp_path, "1.csv")
    with pytest.raises(FileNotFoundError):
        load(spark, tmp_path)


def test_typing_and_defaults(spark, tmp_path):
    write(
        tmp_path, "a b+c%41.csv", HEADER,
        line(runs_off_bat="4", wides="5d", noballs=" 1 ", byes="abc", innings=" 2",
             wicket_type="", season="NA", venue='"Oval, ""East"" side"', batting_team='""'),
    )
    write(tmp_path, "1_info.csv", "info,venue,V")
    source = load(spark, tmp_path)
    row, = source.deliveries.collect()
    assert source.deliveries.columns == DELIVERY_COLUMNS
    assert (row["runs_off_bat"], row["wides"], row["noballs"], row["byes"], row["legbyes"]) == (
        4.0, 0.0, 1.0, 0.0, 0.0)
    assert (row["innings"], row["season"], row["venue"]) == (2, "NA", 'Oval, "East" side')
    assert row["wicket_type"] == "" and row["batting_team"] is None and row["non_striker"] is None
    assert [r["stem"] for r in source.loaded.collect()] == ["a b+c%41"]


def test_files_are_matched_by_column_name(spark, tmp_path):
    write(tmp_path, "1.csv", HEADER, line(match_id="1", bowler="w"))
    write(tmp_path, "2.csv", HEADER, line(match_id="2"))
    write(tmp_path, "3.csv", "bowler,striker,match_id,umpire", "x,y,3,U", "x,,3,")
    write(tmp_path, "4.csv", "﻿match_id,runs_off_bat", "4,6", "", "   ", "4")
    source = load(spark, tmp_path)
    got = rows_by_match(source)
    assert source.deliveries.columns == [*DELIVERY_COLUMNS, "umpire"]
    assert got["1"][0]["bowler"] == "w" and got["1"][0]["umpire"] is None
    assert sorted((r["bowler"], r["striker"], r["umpire"]) for r in got["3"] if r["striker"]) == [
        ("x", "y", "U")]
    assert got["3"][0]["venue"] is None and got["3"][0]["runs_off_bat"] == 0.0
    assert got["3"][0]["wicket_type"] == ""
    # Blank lines are no deliveries, a short line is filled up.
    assert sorted(r["runs_off_bat"] for r in got["4"]) == [0.0, 6.0]


def test_odd_headers(spark, tmp_path):
    write(tmp_path, "1.csv", "", "  ", 'match_id,"Striker",striker,we`ird,wides,wides', "1,no,yes,w,1,2")
    source = load(spark, tmp_path)
    row, = source.deliveries.collect()
    assert (row["match_id"], row["striker"], row["we`ird"], row["wides"]) == ("1", "yes", "w", 1.0)
    assert source.deliveries.columns == [*DELIVERY_COLUMNS, "we`ird"]


def test_unreadable_files_are_left_out_whole(spark, tmp_path):
    write(tmp_path, "good.csv", HEADER, line(match_id="good"))
    write(tmp_path, "short.csv", HEADER, "short,2020", line(match_id="short"))
    write(tmp_path, "long.csv", HEADER, line(match_id="long"), line(match_id="long") + ",")
    write(tmp_path, "quoted.csv", HEADER, line(match_id="quoted", venue='"a,b,c"'))
    write(tmp_path, "latin.csv", HEADER, line(match_id="latin", venue="X").encode() + b"\xe9")
    write(tmp_path, "empty.csv")
    write(tmp_path, "header.csv", HEADER)
    write(tmp_path, "_hidden.csv", HEADER, line(match_id="hidden"))
    with pytest.warns(UserWarning, match="4 delivery files"):
        source = load(spark, tmp_path)
    assert set(rows_by_match(source)) == {"good", "short", "quoted"}
    assert {r["stem"]: r["reason"] for r in source.quarantined.collect()} == {
        "long": "more fields than the header", "latin": "not UTF-8", "empty": "empty", "_hidden": "hidden by its name"}
    assert sorted(r["stem"] for r in source.loaded.collect()) == [
        "good", "header", "quoted", "short"]


def test_records_that_span_lines(spark, tmp_path):
    write(tmp_path, "1.csv", HEADER, line(match_id="1", venue='"two\nlines, one field"'))
    write(tmp_path, "2.csv", HEADER, line(match_id="2") + ",over")
    write(tmp_path, "3.csv", HEADER, line(match_id="3", venue='"never closed'))
    write(tmp_path, "4.csv", HEADER, line(match_id="4"))
    with pytest.warns(UserWarning):
        source = load(spark, tmp_path)
    got = rows_by_match(source)
    assert set(got) == {"1", "4"}
    assert got["1"][0]["venue"] == "two\nlines, one field"
    assert {r["stem"]: r["reason"] for r in source.quarantined.collect()} == {
        "2": "more fields than the header", "3": "unclosed quote"}


def test_large_file_is_read_in_splits(spark, tmp_path):
    body = [line(match_id="big", ball=f"{i % 20}.1", runs_off_bat=str(i % 7)) for i in range(4000)]
    write(tmp_path, "big.csv", HEADER, *body)
    write(tmp_path, "other.csv", "ball,match_id", "3.1,other")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        source = load(spark, tmp_path)
        assert source.deliveries.rdd.getNumPartitions() > 3
        got = rows_by_match(source)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got["big"]) == 4000 and len(got["other"]) == 1
    assert sum(r["runs_off_bat"] for r in got["big"]) == sum(i % 7 for i in range(4000))


def test_odd_information_lines(spark, tmp_path):
    write(tmp_path, "1.csv", HEADER, line(match_id="1"))
    write(
        tmp_path, "1_info.csv", 'info,city,St John"s', 'info,toss_winner,O"Neil XI, East', "info,winner,\tX\t",
        "info,season," + '"a,",' * 25_000, 'info,venue,"Oval, ""East"" side"', "info,event, Cup\u00a0",
    )
    source = load(spark, tmp_path)
    row, = read_match_info(spark, str(tmp_path), source.loaded).collect()
    assert (row["city"], row["toss_winner"], row["winner"]) == ('St John"s', 'O"Neil XI,East', "X")
    assert (row["season"], row["venue"], row["event"]) == ("a,", 'Oval, "East" side', "Cup")


def test_match_information(spark, tmp_path):
    for name in ("1", "2", "3", "4"):
        write(tmp_path, f"{name}.csv", HEADER, line(match_id=name))
    write(tmp_path, "5.csv", HEADER, line() + ",bad")
    write(
        tmp_path, "1_info.csv", "version,2.1.0", "info,team,A", "info,team, B ,C", "info,season,2020",
        "info,season,2021", 'info,venue,"Oval, East"', "info,winner,A", "info,winner_runs,35",
        "info,winner_runs,none", "info,toss_decision,field", 'info,event,"Cup, Final"',
        "info,player,A,Somebody", "info,umpire", "other,city,Nope", "info,date,2020/01/01",
        "info,player_of_match,Some Body",
    )
    write(tmp_path, "2_info.csv", "info,venue,Oval , West", "info,winner_wickets,5", end="\r\n")
    write(tmp_path, "3_info.csv", "")
    write(tmp_path, "5_info.csv", "info,venue,X")
    write(tmp_path, "9_info.csv", "info,venue,no deliveries")
    with pytest.warns(UserWarning):
        source = load(spark, tmp_path)
    info = read_match_info(spark, str(tmp_path), source.loaded)
    got = {r["match_id"]: r.asDict() for r in info.collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"] == {
        "match_id": "1", "venue": "Oval, East", "city": "", "season": "2021",
        "date": "2020/01/01", "event": "Cup, Final", "match_number": "", "toss_winner": "",
        "toss_decision": "field", "winner": "A", "winner_runs": 35, "winner_wickets": None,
        "player_of_match": "Some Body", "teams": ["A", "B,C"],
    }
    assert (got["2"]["venue"], got["2"]["winner_wickets"], got["2"]["teams"]) == (
        "Oval,West", 5, [])
    assert got["3"]["venue"] == "" and got["3"]["winner_runs"] is None


def test_clean_directory_needs_no_join(spark, tmp_path):
    for name in "123":
        write(tmp_path, f"{name}.csv", HEADER, line(match_id=name))
    plan = load(spark, tmp_path).deliveries._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_an_unclosed_quote_leaves_the_others_splittable(spark, tmp_path):
    for name in "12":
        write(tmp_path, f"{name}.csv", HEADER, *[line(match_id=name)] * 2000)
    write(tmp_path, "3.csv", HEADER, line(match_id="3", venue='"never closed'))
    write(tmp_path, "4 [x].csv", HEADER, line(match_id="4", venue='"two\nlines"'))
    with pytest.warns(UserWarning, match="1 delivery files"):
        source = load(spark, tmp_path)
    got = rows_by_match(source)
    assert {k: len(v) for k, v in got.items()} == {"1": 2000, "2": 2000, "4": 1}
    assert got["4"][0]["venue"] == "two\nlines"


def test_fields_of_information_lines(spark):
    def expected(text):
        inside, fields, closed = False, [""], text.count('"') % 2 == 0
        for sign in text:
            inside ^= sign == '"'
            if sign == "," and not (closed and inside):
                fields.append("")
            else:
                fields[-1] += sign
        return [field.strip().strip('"').replace('""', '"') for field in fields]

    signs = ["a", ",", '"', " ", "\n", "﷐", "é"]
    lines = ["".join(line) for n in range(5) for line in product(signs, repeat=n)]
    lines += [",\U0001F3CF," + '"a,' * 40_000, "info,season," + '"a,"",' * 40_001 + '"']
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    for line, fields in rows.select("line", _fields(F.col("line"))).collect():
        assert fields == expected(line), line


def test_information_lines_are_spread_by_matches(spark, monkeypatch):
    monkeypatch.setattr(queries, "INFO_MATCHES", 5, raising=False)
    parsed = queries.ingest_match_info(spark, "/root/testdata/sf0.001")
    assert parsed.rdd.getNumPartitions() > parsed.count() // 5


def test_lines_are_not_sorted_and_headers_stay_exact(spark, tmp_path, monkeypatch):
    plans = []

    def recorded(frame, label):
        plans.append((label, frame._jdf.queryExecution().executedPlan().toString()))
        return written(frame, label)

    monkeypatch.setattr(deliveries, "written", recorded)
    write(tmp_path, "1.csv", "", HEADER, line(match_id="1", venue='""'), line(match_id="1", venue='"A, ""B"""'))
    write(tmp_path, "2.csv", 'striker,"match_id"', '"x","2"')
    write(tmp_path, "3.csv", "striker,match_id", 'y,"3"",4"', '"",""')
    write(tmp_path, "4.csv", "a,b", '"x"",""y",1,2')
    with pytest.warns(UserWarning, match="1 delivery files"):
        got = rows_by_match(load(spark, tmp_path))
    assert {key: [row["striker"] for row in rows] for key, rows in got.items()} == {
        "1": ["s", "s"], "2": ["x"], '3",4': ["y"], None: [None]}
    assert sorted(row["venue"] or "" for row in got["1"]) == ["", 'A, "B"']
    assert not any("SortAggregate" in plan for label, plan in plans if label in ("files", "file-lines"))
    assert "file-lines" in dict(plans)
