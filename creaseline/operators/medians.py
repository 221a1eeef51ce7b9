"""Exact grouped median whose work stays spread out when one group holds most of the rows."""

from pyspark.sql import DataFrame

from creaseline.functions import double
from creaseline.operators.rollups import summed


def grouped_median(
    rows: DataFrame, keys: list[str], value: str, width: float = 1 / 64
) -> DataFrame:
    """(keys, median): the interpolating median of the non-NULL `value`s of each group.

    The built-in exact median holds a whole group in one task. Here equal values are first counted
    and the counts summed over buckets of the value range; these tell which bucket holds the middle
    ranks, and only that bucket's distinct values are ordered. `width` sizes the buckets and never
    changes the answer; a power of two keeps their order exact.
    """
    key = ", ".join(keys)
    counted = summed(
        rows.filter(f"{value} IS NOT NULL").selectExpr(
            *keys, value, f"floor({value} / {double(width)}) AS _bucket"
        ),
        [*keys, "_bucket", value], ["count(1) AS _n"],
    )
    # A row spans the ranks [_before, _before + _n); the middle ranks are _low and _high.
    holds_middle = "_before <= _high AND _before + _n > _low"
    buckets = (
        summed(counted, [*keys, "_bucket"], ["sum(_n) AS _n"])
        .selectExpr(
            "*",
            f"sum(_n) OVER (PARTITION BY {key} ORDER BY _bucket) - _n AS _before",
            f"sum(_n) OVER (PARTITION BY {key}) AS _total",
        )
        .selectExpr("*", "(_total - 1) DIV 2 AS _low", "_total DIV 2 AS _high")
        .filter(holds_middle)
        .selectExpr(*keys, "_bucket", "_before AS _start", "_low", "_high")
    )
    ranked = (
        counted.join(buckets, [*keys, "_bucket"])
        .selectExpr(
            "*",
            f"_start + sum(_n) OVER (PARTITION BY {key}, _bucket ORDER BY {value}) - _n"
            " AS _before",
        )
        .filter(holds_middle)
    )
    # At most two distinct values are left per group: those at the lower and the upper middle rank.
    return summed(ranked, keys, [f"(min({value}) + max({value})) / 2 AS median"])
