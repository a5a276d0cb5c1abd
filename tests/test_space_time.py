"""The nearest row in time and space against a plain search, also across the date line and about the poles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rainloom.functions.geo import haversine_km
from rainloom.operators import joins


def km(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("most", [50.0, 800.0, 9000.0])
def test_nearest_in_space(spark, most):
    rng = random.Random(most)
    place = lambda: rng.choice([(rng.uniform(-180, 180), rng.uniform(-90, 90)), (rng.choice([-179.9, 179.9, 180.0, -180.0]), rng.uniform(-60, 60)), (rng.uniform(-180, 180), rng.choice([-89.8, 89.5, 88.0])), (120.0 + rng.random(), 20.0 + rng.random())])
    left = [(i, rng.randrange(100), *place()) for i in range(120)] + [(120, 5, None, 1.0), (121, 10_000, 1.0, 1.0)]
    right = [(i, rng.randrange(100), *place()) for i in range(300)] + [(300, 5, 1.0, None), (301, 50, 120.5, 20.5), (302, 50, 120.5, 20.5)]
    a = spark.createDataFrame(left, "id long, x long, lon double, lat double").repartition(3)
    b = spark.createDataFrame(right, "rid long, t long, lon2 double, lat2 double").repartition(4)
    got = {r.id: (r.status, r.rid, r.cost) for r in joins.nearest_in_space(a, b, "x", "t", 10, ("lon", "lat"), ("lon2", "lat2"), most, "id", ["rid"], ["t", "rid"]).collect()}
    assert len(got) == len(left)
    for i, x, lon, lat in left:
        near = sorted((km(lon, lat, c, d), t, r) for r, t, c, d in right if abs(t - x) <= 10 and None not in (lon, c, d))
        if not near:
            assert got[i] == ("no_candidate", None, None)
            continue
        d, _, rid = near[0]
        status, r, cost = got[i]
        assert cost == pytest.approx(d, abs=1e-6) and (status, r) == (("matched", rid) if d <= most else ("too_far", None))


def test_mirrored_places(spark):
    """Distances as the SQL's roundings give them: two places are 436.0436 km away, and the second is nearer in its last digits."""
    x = spark.createDataFrame([(1, 140.0, 0.0, 143.7, 1.2999999999999972), (2, 140.0, 0.0, 138.7, -3.700000000000003)], "i long, a double, b double, c double, d double")
    got = {r.i: r.km for r in x.select("i", haversine_km(*map(F.col, "abcd")).alias("km")).collect()}
    assert got == {1: 436.0436429572497, 2: 436.0436429572437}
