import math
import random

import pandas as pd
import pytest

from creaseline import functions as f


def evaluate(spark, expression, values, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").selectExpr(f"{expression} AS y").collect()]


def test_scaled_round_works_on_the_scaled_value(spark):
    got = evaluate(spark, f.scaled_round("x", 2), [1.005, 2.5, 0.125, 0.135, -1.005])
    assert got == [round_scaled(v) for v in [1.005, 2.5, 0.125, 0.135, -1.005]]
    assert got[0] == 1.0


def round_scaled(value):
    scaled = value * 100
    return float(pd.Series([scaled]).round(0).iloc[0]) / 100


@pytest.mark.parametrize("digits", [2, 3, 4])
def test_half_even_is_exact(spark, digits):
    rng = random.Random(digits)
    scale = 10 ** digits
    ties = [(rng.randrange(0, 10 ** 6) + 0.5) / scale for _ in range(2000)]
    near = [math.nextafter(t, math.inf) for t in ties[:300]]
    plain = [rng.uniform(-500, 500) for _ in range(500)]
    values = ties + near + plain + [0.0, 2.675, 1.005]
    assert evaluate(spark, f.half_even("x", digits), values) == [round(v, digits) for v in values]


def test_number_parses_like_a_strict_reader(spark):
    texts = [" 5 ", "5d", "1e1", "nan", ".5", "5.", "+3", "0x1F", "1_0", "", "1E+2", "abc", "-4.5"]
    expected = pd.to_numeric(pd.Series(texts), errors="coerce")
    got = evaluate(spark, f.number("x"), texts, "string")
    assert [None if pd.isna(v) else float(v) for v in expected] == got
    assert evaluate(spark, f.number_or_zero("x"), ["7", None, "7f"], "string") == [7.0, 0.0, 0.0]


def test_whole_number(spark):
    texts = ["1", " 2 ", "1.0", "x", None, "99999999999"]
    assert evaluate(spark, f.whole_number("x"), texts, "string") == [1, 2, None, None, None, None]


def test_safe_div_fills(spark):
    assert evaluate(spark, f.safe_div("10", "x", 999.0), [0.0, 4.0]) == [999.0, 2.5]


def test_wilson_lower_known_values(spark):
    rows = spark.createDataFrame([(1, 25), (0, 6), (0, 0), (6, 6)], "s bigint, n bigint")
    got = [r[0] for r in rows.selectExpr(f"{f.wilson_lower('s', 'n')} AS w").collect()]
    assert got == [0.0071, 0.0, 0.0, 0.6097]


def test_wilson_lower_stays_below_the_share(spark):
    rows = spark.sql("SELECT s.id AS s, n.id AS n FROM range(0, 40) s JOIN range(1, 40) n"
                     " ON s.id <= n.id")
    low = rows.selectExpr("s", "n", f"{f.wilson_lower('s', 'n')} AS w")
    assert low.filter("w < 0 OR w > s / n + 0.00005").isEmpty()


def test_batting_average_without_dismissal_is_the_run_total(spark):
    rows = spark.createDataFrame([(37.0, 0), (50.0, 3)], "r double, d bigint")
    got = [r[0] for r in rows.selectExpr(f"{f.batting_average('r', 'd')} AS a").collect()]
    assert got == [37.0, 16.67]
