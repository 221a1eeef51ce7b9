"""Numeric helpers over SQL text."""

# Text accepted as a number. Spark's own cast also takes suffixes such as '5d', hence the guard.
_NUMBER = (
    r"^[ \t]*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf(inity)?))[ \t]*$"
)
_WHOLE = "^[ \t]*[+-]?[0-9]+[ \t]*$"

# 2^27 + 1: splits a double into two halves whose products with small integers are exact.
_SPLITTER = 134217729


def double(value: float) -> str:
    """A DOUBLE literal."""
    return f"{float(value)!r}D"


def number(text: str) -> str:
    """Text to DOUBLE; NULL where the text is not a number. Only text with letters needs the guard."""
    return (
        f"CASE WHEN upper({text}) = lower({text}) OR {text} RLIKE '{_NUMBER}'"
        f" THEN try_cast({text} AS DOUBLE) END"
    )


def number_or_zero(text: str) -> str:
    return f"coalesce({number(text)}, 0D)"


def whole_number(text: str, kind: str = "INT") -> str:
    """Text to an integer type; NULL where the text is not a whole number that fits."""
    return f"CASE WHEN {text} RLIKE '{_WHOLE}' THEN try_cast({text} AS {kind}) END"


def safe_div(num: str, den: str, fill: float = 0.0) -> str:
    """num / den, or `fill` where the denominator is 0."""
    return f"CASE WHEN {den} = 0 THEN {double(fill)} ELSE ({num}) / {den} END"


def scaled_round(value: str, digits: int) -> str:
    """Round half-even on the scaled value: 1.005 gives 1.0, where Spark's round() gives 1.01."""
    scale = double(10 ** digits)
    return f"rint(({value}) * {scale}) / {scale}"


def half_even(column: str, digits: int) -> str:
    """Round the exact binary value, half-even: 2.675 (stored just below) gives 2.67.

    Scaling can land on a tie that the stored value does not sit on. The scaled product's rounding
    error is computed exactly and breaks such false ties.
    """
    scale = double(10 ** digits)
    scaled = f"({column} * {scale})"
    spread = f"({column} * {_SPLITTER}D)"
    high = f"({spread} - ({spread} - {column}))"
    error = f"(({high} * {scale} - {scaled}) + ({column} - {high}) * {scale})"
    tie = f"{scaled} - floor({scaled}) = 0.5D"
    return (
        f"CASE WHEN {tie} AND {error} < 0 THEN CAST(floor({scaled}) AS DOUBLE)"
        f" WHEN {tie} AND {error} > 0 THEN CAST(ceil({scaled}) AS DOUBLE)"
        f" ELSE rint({scaled}) END / {scale}"
    )


def wilson_lower(successes: str, trials: str, z: float = 1.96) -> str:
    """Lower end of the Wilson score interval, clipped to [0, 1], 4 decimals; 0.0 for no trials."""
    n = f"CAST({trials} AS DOUBLE)"
    p = f"({successes} / {n})"
    z1, z2 = double(z), double(z ** 2)
    centre = f"{p} + {z2} / (2 * {n})"
    margin = f"{z1} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n}))"
    lower = f"({centre} - {margin}) / (1 + {z2} / {n})"
    clipped = scaled_round(f"greatest(0D, least(1D, {lower}))", 4)
    return f"CASE WHEN {trials} = 0 THEN 0D ELSE {clipped} END"
