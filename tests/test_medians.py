import random

import numpy as np
import pytest

from creaseline.operators.medians import grouped_median


@pytest.mark.parametrize("width", [1 / 64, 16.0])
def test_matches_the_plain_median(spark, width):
    rng = random.Random(5)
    groups = {"hot": [rng.randrange(0, 400) * 6 / rng.randrange(1, 19) for _ in range(3000)],
              "one": [4.25], "two": [1.0, 2.0], "same": [3.5] * 50, "below": [-1.5, -0.25, 7.0],
              "ties": [1.0] * 10 + [9.0] * 10}
    for i in range(30):
        groups[f"g{i}"] = [rng.uniform(0, 40) for _ in range(rng.randrange(1, 60))]
    rows = [(k, v) for k, values in groups.items() for v in values] + [("hot", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["median"] for r in grouped_median(frame, ["k"], "v", width).collect()}
    assert got == {k: float(np.median(v)) for k, v in groups.items()}
