"""Land and coasts against plain geometry."""

import math

from rainloom.operators import coast, grid, stats


def test_square(spark):
    ring = [(0, 0, 10.0, 10.0), (0, 1, 12.0, 10.0), (0, 2, 12.0, 12.0), (0, 3, 10.0, 12.0)]
    s = coast.segments(spark.createDataFrame(ring, "poly int, i int, x double, y double"))
    assert s.count() == 4
    p = spark.createDataFrame([(1, 11.0, 11.0), (2, 12.5, 11.0), (3, 50.0, 50.0), (4, 10.5, 11.9)], "k int, lon double, lat double")
    got = {r.k: (r.on_land, r.coast_km) for r in coast.coast_distance(coast.on_land(p, s, "k"), s, "k", 200.0).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[3][1] is None and abs(got[4][1] - 0.1 * 111.32) < 1e-6
    assert abs(got[2][1] - 0.5 * 111.32 * math.cos(math.radians(11.0))) < 1e-6
    assert coast.on_land(p.limit(0), s, "k").count() == 0


def test_key_locations_and_refit(spark):
    c = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("a", 1, 0, 3.0), ("b", 2, 2, None)], "e string, r int, c int, v double")
    got = {r.e: (r.r, r.c, r.value) for r in grid.key_locations(c.where("v is not null"), ["e"], ["r", "c"], ["v"]).collect()}
    assert got == {"a": (0, 1, 3.0)}
    b = spark.createDataFrame([(1.0, 5.0), (2.0, 7.0), (3.0, 9.0)], "x double, z double")
    out = stats.refit(b, b.selectExpr("x + 1 AS x", "z"), [], "x", "z").collect()
    assert all(abs(r.z - (2 * r.x + 3)) < 1e-9 for r in out)


def test_equal_outlines_are_searched_once(spark):
    """Copies of a polygon make no work, whatever the order of their segments; rings that only share segments stay apart."""
    square = [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 4.0), (4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)]
    other = [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)]
    rows = [(p, *s) for p in range(50) for s in (square[p % 4 :] + square[: p % 4])] + [(60, *s) for s in other]
    s = spark.createDataFrame(rows, "poly int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    assert sorted(tuple(r) for r in coast.distinct_outlines(s).collect()) == sorted((p, *e) for p, ends in ((0, square), (60, other)) for e in ends)
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.5, 3.5), (3, 5.0, 1.0)], "id int, lon double, lat double")
    assert {r.id: r.on_land for r in coast.on_land(p, s).collect()} == {1: True, 2: True, 3: False}
    assert coast.land_cells(s, 1.0).count() == 16


def test_vertices_of_many_parts_come_together():
    """A frame holds many parts: one a part took nearly all of the time of a file of small islands."""
    import pandas as pd

    from rainloom.sources.polygons import _frames, shape_bytes

    ring = lambda k: [(k, 0.0), (k, 1.0), (k + 1.0, 1.0), (k + 1.0, 0.0)]
    data = shape_bytes([[ring(float(k))] for k in range(100)])
    frames = list(_frames("a", data))
    assert [len(f) for f in frames] == [400]
    assert [len(f) for f in _frames("a", data, 100)] == [100] * 4
    assert pd.concat(_frames("a", data, 1), ignore_index=True).equals(frames[0])
    assert [f["error"].notna().sum() for f in _frames("a", data[:-8])] == [0, 1]
