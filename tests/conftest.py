import os
import shutil
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="creaseline-tests-")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("creaseline-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    shutil.rmtree(folder)


DEFAULTS = {
    "match_id": "m1", "season": "2020", "start_date": "2020-01-01", "venue": "V", "innings": 1,
    "ball": "0.1", "batting_team": "A", "bowling_team": "B", "striker": "bat",
    "non_striker": "other", "bowler": "bowl", "runs_off_bat": 0.0, "extras": 0.0, "wides": 0.0,
    "noballs": 0.0, "byes": 0.0, "legbyes": 0.0, "penalty": 0.0, "wicket_type": "",
    "player_dismissed": "", "other_wicket_type": "", "other_player_dismissed": "",
}
_TYPES = {
    "innings": "int",
    **dict.fromkeys(
        ["runs_off_bat", "extras", "wides", "noballs", "byes", "legbyes", "penalty"], "double"
    ),
}


@pytest.fixture(scope="session")
def make_fact(spark):
    """Enriched deliveries from partial rows; what a row leaves out takes a default."""
    from creaseline.operators.features import enrich

    schema = ", ".join(f"{name} {_TYPES.get(name, 'string')}" for name in DEFAULTS)

    def make(rows):
        full = [tuple({**DEFAULTS, **row}[name] for name in DEFAULTS) for row in rows]
        return enrich(spark.createDataFrame(full, schema))

    return make
