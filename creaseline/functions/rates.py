"""Rate metrics shared by the batting and bowling tables."""

from creaseline.functions.numeric import safe_div, scaled_round


def strike_rate(runs: str, balls: str) -> str:
    return safe_div(f"({runs}) * 100", balls)


def per_over(runs: str, balls: str) -> str:
    return safe_div(f"({runs}) * 6", balls)


def percent(part: str, whole: str) -> str:
    return f"({safe_div(part, whole)}) * 100"


def batting_average(runs: str, dismissals: str, digits: int | None = 2) -> str:
    """Runs per dismissal; the plain run total for a batter who was never out."""
    ratio = f"{runs} / {dismissals}"
    if digits is not None:
        ratio = scaled_round(ratio, digits)
    return f"CASE WHEN {dismissals} = 0 THEN {runs} ELSE {ratio} END"


# Sums over legal deliveries; the caller filters on is_legal.
BATTING_MEASURES = [
    "count(1) AS balls_faced",
    "sum(runs_off_bat) AS runs_scored",
    "count_if(is_batter_out) AS dismissals",
    "count_if(is_dot) AS dot_balls",
    "count_if(is_boundary4) AS fours",
    "count_if(is_boundary6) AS sixes",
]

# Rounded rates on top of BATTING_MEASURES.
BATTING_RATES = [
    f"{scaled_round(strike_rate('runs_scored', 'balls_faced'), 2)} AS strike_rate",
    f"{batting_average('runs_scored', 'dismissals')} AS average",
    f"{scaled_round(percent('dot_balls', 'balls_faced'), 2)} AS dot_pct",
    f"{scaled_round(percent('fours + sixes', 'balls_faced'), 2)} AS boundary_pct",
]
