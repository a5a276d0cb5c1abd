"""Shape files, land rasters, distances across the date line and near the poles, and the calibration's state."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from rainloom.functions import geo
from rainloom.operators import calibration, coast
from rainloom.sources import polygons

OUTER, HOLE = [(0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]


def test_round_trip_of_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.shp").write_bytes(polygons.shape_bytes([[OUTER, HOLE], None, [[(9.0, 9.0), (10.0, 9.0), (9.5, 8.0)]]]))
    (tmp_path / "b.shp").write_bytes(polygons.shape_bytes([[[(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]]], polygons.LINE))
    whole = polygons.shape_bytes([[OUTER], [HOLE]])
    (tmp_path / "c.shp").write_bytes(whole[:-20])
    (tmp_path / "d.shp").write_bytes(b"nothing")
    (tmp_path / "e.shp").write_bytes(polygons.shape_bytes([]))
    (tmp_path / "f.dbf").write_bytes(b"other")
    rows = polygons.read_shapes(spark, str(tmp_path)).collect()
    of = lambda name: sorted(((r.record, r.part, r.i, r.x, r.y, r.kind) for r in rows if r.path.endswith(name) and not r.error))
    ring = lambda record, part, points, kind: [(record, part, i, x, y, kind) for i, (x, y) in enumerate(points)]
    assert of("a.shp") == ring(1, 0, OUTER, "outer") + ring(1, 1, HOLE, "hole") + ring(3, 0, [(9.0, 9.0), (10.0, 9.0), (9.5, 8.0)], "outer")
    assert of("b.shp") == ring(1, 0, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)], "line")
    assert of("c.shp") == ring(1, 0, OUTER, "outer") and of("e.shp") == []
    assert {r.path.rsplit("/", 1)[1]: r.error for r in rows if r.error} == {"c.shp": "record 2 is cut off", "d.shp": "no shape file"}


def test_measured_shapes_are_read_flat(spark):
    flat = polygons.shape_bytes([[OUTER]])
    body = flat[polygons.HEADER + 8 :]
    measured = struct.pack("<i", 25) + body[4:] + struct.pack("<6d", 0, 1, 0, 0, 0, 0)
    data = flat[: polygons.HEADER] + struct.pack(">2i", 1, len(measured) // 2) + measured
    got = polygons.parse_shapes(spark.createDataFrame([("m", bytearray(data))], "path string, content binary")).collect()
    assert [(r.x, r.y) for r in got] == OUTER


@pytest.fixture(scope="module")
def lakes(spark):
    east = [(x + 178, y) for x, y in OUTER]
    data = polygons.shape_bytes([[OUTER, HOLE], [east], [[(-60.0, 70.3), (-50.1, 72.7), (-49.2, 68.1), (-55.5, 69.0)]], [[(2.0, 2.0), (6.0, 2.5), (5.0, -2.0)]]])
    return coast.shape_segments(polygons.parse_shapes(spark.createDataFrame([("m", bytearray(data))], "path string, content binary"))).cache()


def test_land_with_a_lake_and_over_the_date_line(spark, lakes):
    p = spark.createDataFrame([(1, 0.5, 0.5), (1, 1.5, 1.5), (2, 181.0, 1.0), (3, -179.0, 1.0), (4, 179.0, 1.0), (5, -177.0, 1.0), (6, None, 1.0), (7, 360.5, 0.5)], "k int, lon double, lat double")
    got = [(r.k, r.lon, r.on_land) for r in coast.on_land(p, lakes, "k").collect()]
    assert sorted(got, key=str) == sorted([(1, 0.5, True), (1, 1.5, False), (2, 181.0, True), (3, -179.0, True), (4, 179.0, True), (5, -177.0, False), (6, None, False), (7, 360.5, True)], key=str)


def test_raster_agrees_at_all_centres(spark, lakes, tmp_path):
    cell = 0.25
    cells = coast.land_cells(lakes, cell)
    coast.store_land(cells, str(tmp_path / "land"), cell)
    stored = spark.read.parquet(str(tmp_path / "land"))
    centres = spark.range(-8, 40).select(F.col("id").alias("irow")).crossJoin(spark.range(-720, 720).select(F.col("id").alias("icol")))
    centres = centres.unionByName(spark.range(270, 295).select(F.col("id").alias("irow")).crossJoin(spark.range(-250, -190).select(F.col("id").alias("icol"))))
    centres = centres.select(((F.col("icol") + 0.5) * cell).alias("lon"), ((F.col("irow") + 0.5) * cell).alias("lat"))
    want = {(r.lon, r.lat) for r in coast.on_land(centres, lakes).collect() if r.on_land}
    got = {(r.lon, r.lat) for r in coast.in_cells(centres, stored, cell).collect() if r.on_land}
    assert got == want and len(got) > 900
    assert {r.band for r in stored.select("band").distinct().collect()} >= {0, 6, 7}


def test_touched_cells(spark):
    data = polygons.shape_bytes([[[(0.1, 0.1), (0.2, 0.9), (2.5, 0.4)]]])
    s = coast.shape_segments(polygons.parse_shapes(spark.createDataFrame([("m", bytearray(data))], "path string, content binary")))
    assert {(r.irow, r.icol) for r in coast.land_cells(s, 1.0, touched=True).collect()} == {(0, 0), (0, 1), (0, 2)}
    assert {(r.irow, r.icol) for r in coast.land_cells(s, 1.0).collect()} == {(0, 0), (0, 1)}


@pytest.mark.parametrize("place,segment,reach", [((-179.9, 10.0), (179.9, 9.0, 179.9, 11.0), 50.0), ((20.0, 84.5), (30.0, 84.0, 31.0, 86.0), 300.0), ((100.0, 89.2), (-90.0, 89.0, -80.0, 89.1), 250.0), ((179.5, 0.0), (-179.0, 0.5, -178.0, 1.0), 400.0)])
def test_distances_round_the_earth(spark, place, segment, reach):
    s = spark.createDataFrame([(0, *segment)], "poly int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, *place), (1, place[0] - 170, -place[1] - 20)], "k int, lon double, lat double")
    near, far = sorted(coast.coast_distance(p, s, "k", reach).collect(), key=lambda r: r.coast_km is None)
    plain = p.where("lon > -1000").select(coast.segment_km(*(F.lit(float(v)) for v in (*place, *segment))).alias("d")).first().d
    assert near.coast_km == pytest.approx(plain) and far.coast_km is None
    with pytest.raises(ValueError):
        coast.coast_distance(p, s, "k", reach, cell=7.0)


def test_mercator_and_back(spark):
    df = spark.createDataFrame([(120.5, 30.25), (-179.0, -80.0), (0.0, 90.0), (10.0, None)], "lon double, lat double")
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    back = geo.from_mercator(F.col("x"), F.col("y"))
    rows = df.select("*", x.alias("x"), y.alias("y")).select("*", back[0].alias("a"), back[1].alias("b")).collect()
    assert rows[0].x == pytest.approx(13413998.6, abs=1) and rows[0].y == pytest.approx(math.log(math.tan(math.radians(30.25) / 2 + math.pi / 4)) * 6378137)
    assert all(r.a == pytest.approx(r.lon) for r in rows) and [rows[i].b for i in (0, 1)] == [pytest.approx(30.25), pytest.approx(-80)]
    assert rows[2].y == pytest.approx(20037508.34, abs=0.1) and rows[3].y is None


def test_calibration_keeps_what_it_cannot_calibrate(spark):
    fields = {"zero": [0.0] * 40, "one": [0.0] * 199 + [9.0], "odd": [float("nan"), None, -3.0, float("inf"), *map(float, range(1, 31))], "fit": [float(i) for i in range(100)], "alone": [float(i) for i in range(50)], "none": [None] * 5}
    cells = spark.createDataFrame([(k, i, v) for k, vs in fields.items() for i, v in enumerate(vs)], "k string, i int, v double")
    t = {"zero": (9, 9, 9, 9, 9), "one": (9, 9, 9, 9, 9), "odd": (None, 28, float("nan"), 150, None), "fit": (110, 60, 300, 200, 115), "none": (1, 1, 1, 1, 1)}
    targets = spark.createDataFrame([(k, *[None if v is None else float(v) for v in vs]) for k, vs in t.items()], "k string, p95 double, p99 double, top double, area double, cap double")
    out = calibration.calibrate(cells, targets, "k", "v", 10.0, ["i"]).cache()
    d = {r.k: r for r in calibration.diagnose(out, "k", "v", 10.0).collect()}
    assert {k: r.issue for k, r in d.items()} == {"zero": "all_zero", "one": "tail_too_small", "odd": "missing_targets:p95,top", "fit": "", "alone": "missing_targets:p95,p99,top,area", "none": "all_zero"}
    value = {(r.k, r.i): (r.calibrated, r.step) for r in out.collect()}
    assert len(value) == sum(map(len, fields.values()))
    assert all(value["zero", i] == (0.0, None) for i in range(40)) and value["one", 199] == (9.0, None)
    assert [value["odd", i][0] for i in range(4)] == [0, 0, 0, 0]
    # p95 and what stands above it are put in order, and end at the cap
    assert d["fit"].top_after == 115 == d["fit"].cap and d["fit"].n_at_cap > 0 and d["fit"].p95_after > d["fit"].p95_before
    assert (d["fit"].area_before, d["fit"].n_lowered, d["fit"].area_after) == (900, 5, 850)
    assert all(value["alone", i][0] == pytest.approx(i) for i in range(50)) and d["alone"].ok is False
