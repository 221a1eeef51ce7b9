"""Delivery flags and derived fields (narrow projections, no shuffle)."""

from pyspark.sql import DataFrame

from creaseline.functions import number_or_zero
from creaseline.schema import NOT_CHARGED

_NOT_CHARGED = ", ".join(f"'{kind}'" for kind in NOT_CHARGED)


def over_number(ball: str) -> str:
    """Whole overs in front of the dot of `over.ball`; 0 where that is not a number.

    Whole numbers parse directly; the general form is only evaluated for anything else.
    """
    over = f"substring_index({ball}, '.', 1)"
    clamped = f"greatest(-2147483648D, least(2147483647D, {number_or_zero(over)}))"
    return f"coalesce(try_cast({over} AS INT), CAST({clamped} AS INT))"


# Powerplay up to over 5, middle up to 14, death up to 100; anything else is the text 'nan'.
_PHASE = """
CASE WHEN over_int < 0 OR over_int > 100 THEN 'nan'
     WHEN over_int <= 5 THEN 'powerplay'
     WHEN over_int <= 14 THEN 'middle'
     ELSE 'death' END"""


def enrich(deliveries: DataFrame) -> DataFrame:
    """Add the boolean flags, `runs_conceded`, `over_int` and `phase` to typed deliveries."""
    return deliveries.selectExpr(
        "*",
        "wides > 0 AS is_wide",
        "noballs > 0 AS is_noball",
        "NOT wides > 0 AS is_legal",
        # Blank text is no wicket; the pattern is only tried on text that is not empty.
        r"coalesce(wicket_type != '' AND wicket_type RLIKE r'(?U)\S', false) AS is_wicket",
        "runs_off_bat + wides + noballs + byes + legbyes AS runs_conceded",
        f"{over_number('ball')} AS over_int",
    ).selectExpr(
        "*",
        f"is_wicket AND wicket_type NOT IN ({_NOT_CHARGED}) AS is_batter_out",
        "is_legal AND runs_off_bat = 4 AS is_boundary4",
        "is_legal AND runs_off_bat = 6 AS is_boundary6",
        "is_legal AND runs_off_bat = 0 AND extras = 0 AS is_dot",
        f"{_PHASE} AS phase",
    )
