"""One-row summaries of a load and of the derived features."""

from pyspark.sql import DataFrame

from creaseline.operators.rollups import summed


def load_summary(deliveries: DataFrame) -> DataFrame:
    return summed(deliveries, [], [
        "count(1) AS deliveries",
        "count(DISTINCT match_id) AS matches",
        "array_sort(collect_set(season)) AS seasons",
    ])


def feature_summary(fact: DataFrame) -> DataFrame:
    return summed(fact, [], [
        "count_if(is_legal) AS legal_deliveries",
        "count_if(is_wicket) AS wickets",
        "count_if(phase = 'powerplay') AS powerplay_deliveries",
        "count_if(phase = 'middle') AS middle_deliveries",
        "count_if(phase = 'death') AS death_deliveries",
        "count_if(phase = 'nan') AS no_phase_deliveries",
    ])
