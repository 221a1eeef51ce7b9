"""Expressions: coercion, guarded arithmetic, rounding and rate metrics.

Each function takes and returns SQL text, to be used with `expr`, `selectExpr`, `filter` or SQL. A
whole projection then reaches the JVM in a few calls, and stays in whole-stage codegen.
"""

from creaseline.functions.numeric import (
    double, half_even, number, number_or_zero, safe_div, scaled_round, whole_number, wilson_lower,
)
from creaseline.functions.rates import (
    BATTING_MEASURES, BATTING_RATES, batting_average, per_over, percent, strike_rate,
)

__all__ = [
    "BATTING_MEASURES", "BATTING_RATES", "batting_average", "double", "half_even", "number",
    "number_or_zero", "per_over", "percent", "safe_div", "scaled_round", "strike_rate",
    "whole_number", "wilson_lower",
]
