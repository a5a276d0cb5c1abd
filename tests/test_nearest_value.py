"""The nearest row in value within a reach against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from rainloom.operators import joins


@pytest.mark.parametrize("spread", [3, 300, 1e-9])
def test_nearest_value_within(spark, spread):
    rng = random.Random(int(spread))
    value = lambda: rng.choice([round(rng.expovariate(1 / 30), 2), rng.randrange(5) * float(spread), -rng.random() * spread, 0.0])
    left = [(i, rng.randrange(-50, 400), value()) for i in range(300)] + [(300, 5, None), (301, 5, float("nan")), (302, 9000, 1.0), (303, 500, 3.0), (304, None, 1.0)]
    right = [(i, rng.randrange(-50, 400), value()) for i in range(400)] + [(400, 5, None), (401, 491, 3.5), (402, 491, 3.5), (403, 509, 900.0)]
    right += [(i + 1000, t, v) for i, t, v in right[:50]]
    a = spark.createDataFrame(left, "id long, x long, v double").repartition(3)
    b = spark.createDataFrame(right, "rid long, t long, w double").repartition(4)
    got = {r.id: (r.status, r.rid, r.cost) for r in joins.nearest_value_within(a, b, "x", "t", 10, "v", "w", ["t", "rid"], 2.5, "id", ["rid"]).collect()}
    assert len(got) == len(left)
    for i, x, v in left:
        near = [] if v is None or v != v or x is None else sorted((abs(v - w), t, r) for r, t, w in right if abs(t - x) <= 10 and w is not None)
        want = ("no_candidate", None, None) if not near else ("matched", near[0][2], near[0][0]) if near[0][0] <= 2.5 else ("too_far", None, near[0][0])
        assert got[i] == want, (i, x, v)


def test_equal_values_meet_once(spark):
    """Copies of a row don't multiply the pairs: 3,000 by 3,000 of one time and value would make 9 million."""
    a = spark.range(3000).select(F.col("id"), F.lit(7).cast("long").alias("x"), F.lit(1.5).alias("v"))
    b = spark.range(3000).select(F.col("id").alias("rid"), F.lit(8).cast("long").alias("t"), F.lit(1.5).alias("w"))
    got = joins.nearest_value_within(a, b, "x", "t", 10, "v", "w", ["t", "rid"], 2.5, "id", ["rid"])
    assert [tuple(r) for r in got.groupBy("rid", "status", "cost").count().collect()] == [(0, "matched", 0.0, 3000)]
