"""Packed rasters give what cells in long form give."""

import random

import pytest
from pyspark.sql import functions as F

from rainloom.operators import grid


@pytest.fixture(scope="module")
def raster(spark):
    rng = random.Random(6)
    frames = [("a", [float(i) if i % 11 else None for i in range(35)]), ("b", [rng.random() for _ in range(35)]), ("short", [1.0] * 9)]
    return spark.createDataFrame(frames, "k string, f array<double>")


@pytest.mark.parametrize("outside", [None, 0.0])
def test_packed_and_long_samples_agree(spark, raster, outside):
    rng = random.Random(7)
    at = lambda n: rng.choice([rng.uniform(-2, n + 1), float(rng.randrange(-1, n + 1))])
    rows = [(i, rng.choice(["a", "b", "short", "none"]), at(5), at(7)) for i in range(600)] + [(600, "a", None, 1.0), (601, "b", 4.0, 6.0), (602, "b", 4.0, 6.0001)]
    points = spark.createDataFrame(rows, "id long, k string, r double, c double").repartition(3)
    cells = raster.select("k", F.posexplode("f").alias("i", "v")).select("k", F.floor(F.col("i") / 7).alias("irow"), (F.col("i") % 7).cast("long").alias("icol"), "v")
    long = {r.id: r.v for r in grid.bilinear(points.withColumn("__id", F.col("id")), cells, ["k"], "r", "c", "v", outside).collect()}
    packed = grid.bilinear_packed(points, raster, ["k"], "r", "c", "f", 5, 7, "v", outside)
    got = {r.id: r.v for r in packed.collect()}
    assert set(got) == set(long) == set(range(603)) and got[601] is not None and (got[602] is None) == (outside is None)
    assert all(got[i] == (None if long[i] is None else pytest.approx(long[i])) for i in got)
    assert packed.columns == ["k", "id", "r", "c", "v"] and sum(v is not None for v in got.values()) > 100


def test_projection_of_packed_fields(spark):
    t = spark.createDataFrame([("s", 1, 120.0, 20.0, 33.0), ("s", 2, 121.0, 21.0, 200.0)], "e string, k long, lon double, lat double, heading double")
    fields = spark.createDataFrame([(1, [float(i) for i in range(25)]), (2, [float(i % 5) for i in range(25)])], "k long, v array<double>")
    cells = grid.geographic_grid(t, ["e"], 0.5, 3.0)
    long = fields.select("k", F.posexplode("v").alias("i", "v")).select("k", F.floor(F.col("i") / 5).alias("iy"), (F.col("i") % 5).cast("long").alias("ix"), "v")
    a = {(r.k, r.ilat, r.ilon): r.v for r in grid.project_back(t, cells, long, ["e"], "k", "v", 200.0, 100.0, 0.5).collect()}
    b = {(r.k, r.ilat, r.ilon): r.v for r in grid.project_back(t, cells, fields, ["e"], "k", "v", 200.0, 100.0, 0.5, packed=True).collect()}
    assert len(a) > 80 and a.keys() == b.keys() and all(b[i] == pytest.approx(a[i]) for i in a)
