"""What the queries don't show: odd input, round trips, numpy as the measure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions import clean, columns, geo
from rainloom.operators import aggregates, calibration, eof, grid, guards, joins, retrieval, scenario, stats, timeseries


def test_geo_round_trips(spark):
    x = spark.range(500).select(((F.col("id") * 37) % 4000 - 2000).alias("e"), ((F.col("id") * 91) % 3000 - 1500).alias("n"), ((F.col("id") * 17) % 360).alias("h"))
    a, b = geo.to_storm_axes(F.col("e"), F.col("n"), F.col("h"))
    x = x.withColumns({"a": a, "b": b})
    e, n = geo.from_storm_axes(F.col("a"), F.col("b"), F.col("h"))
    assert x.where((F.abs(e - F.col("e")) > 1e-6) | (F.abs(n - F.col("n")) > 1e-6)).isEmpty()
    one = spark.range(1).select(geo.wrap180(F.lit(-190.0)).alias("a"), geo.wrap180(F.lit(180.0)).alias("b"), geo.wrap360(F.lit(-10.0)).alias("c"), geo.haversine_km(F.lit(179.5), F.lit(0.0), F.lit(-179.5), F.lit(0.0)).alias("d"), geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("e"), geo.angle_difference(F.lit(350.0), F.lit(10.0)).alias("f"), geo.in_front(F.lit(80.0), F.lit(0.0)).alias("g"), geo.cell_area_km2(F.lit(0.0), 0.1).alias("h")).first()
    assert (one.a, one.b, one.c, one.f, one.g) == (170.0, -180.0, 350.0, -20.0, 1)
    assert one.d == pytest.approx(111.19, abs=0.01) and one.e == pytest.approx(20015.09, abs=0.01) and one.h == pytest.approx(11.132**2)


def test_clean(spark):
    df = spark.createDataFrame([("1.5", float("nan"), 0.0), ("x", float("inf"), 2.0), (None, -3.0, None)], "s string, v double, d double")
    rows = df.select(clean.to_number(F.col("s")).alias("n"), clean.finite(F.col("v")).alias("v"), clean.safe_ratio(F.lit(1.0), F.col("d")).alias("r"), clean.flag(F.col("d") > 1).alias("f"), clean.rain_value(F.col("v")).alias("rain"), clean.clipped(F.col("d"), 0.5, 1.5).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(1.5, None, None, 0, None, 0.5), (None, None, 0.5, 1, None, 1.5), (None, -3.0, None, 0, 0.0, None)]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "track_lon int, wind int, rain_max int")
    assert columns.TRACK.apply(df).columns == ["track_lon", "wind", "rain_max", "lon"]
    assert columns.prefixed(df, "track_", ["rain_max"]).columns == ["track_lon", "track_wind", "rain_max"]
    assert columns.without(df, columns.LEAKS).columns == ["track_lon", "wind"]
    assert columns.ordered(df, ["wind", "none"]).columns == ["wind", "track_lon", "rain_max"]
    with pytest.raises(columns.ContractError):
        columns.assert_no_leakage(df)
    with pytest.raises(columns.ContractError):
        columns.require(df, ["pressure"])


def test_series_edges(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 10, 5.0), (1, 20, None), (2, 0, None), (3, 5, 7.0)], "k int, x long, v double")
    assert sorted((r.k, r.x, r.v) for r in timeseries.fill_by_position(df, ["k"], ["x"], "v").collect() if r.v is not None) == [(1, 0, 5.0), (1, 10, 5.0), (1, 20, 5.0), (3, 5, 7.0)]
    track = spark.createDataFrame([(1, 0, 170.0), (1, 10, -170.0)], "k int, x long, lon double")
    points = spark.createDataFrame([(1, -5, "a"), (1, 5, "b"), (1, 10, "c"), (1, 99, "d"), (2, 1, "e")], "k int, x long, id string")
    got = {r.id: (r.lon, r.outside) for r in timeseries.at_times(points, track, ["k"], "x", [], ["lon"]).collect()}
    assert got == {"a": (170.0, True), "b": (-180.0, False), "c": (-170.0, False), "d": (-170.0, True), "e": (None, True)}
    assert timeseries.interpolate(track.limit(0), ["k"], ["x"], "x", ["lon"], 5).collect() == []


def test_joins_odd(spark):
    a = spark.createDataFrame([(1, 10), (2, 99)], "id int, x long")
    empty = spark.createDataFrame([], "t long, tv double")
    out = joins.nearest_within(a, empty, "x", "t", 3, F.col("tv"), ["t"], 1.0, "id", ["tv"]).collect()
    assert {r.status for r in out} == {"no_candidate"}
    with pytest.raises(columns.ContractError):
        joins.join_one_to_one(a.union(a), a, ["id"])
    b = spark.createDataFrame([(1, 5.0)], "id int, x double")
    assert joins.replace_columns(a, b, ["id"]).where("id = 1").first().x == 5.0
    assert joins.missing_rates(spark.createDataFrame([(None,), (1.0,)], "v double"), ["v"]).first().v == 0.5


def test_weighted_shape_is_numpys(spark):
    rng = np.random.default_rng(0)
    p, w = rng.normal(size=(300, 2)) @ np.array([[3, 1], [0, 1]]), rng.random(300)
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for (a, b), c in zip(p, w, strict=True)] + [(1, 0.0, 0.0, -1.0), (2, 1.0, 1.0, 1.0)], "k int, x double, y double, w double")
    r = {x.k: x for x in aggregates.weighted(df, ["k"], "x", "y", "w").collect()}
    values, vectors = np.linalg.eigh(np.cov(p.T, aweights=w, ddof=0))
    assert (r[1].major, r[1].minor) == pytest.approx(tuple(np.sqrt(values[::-1])))
    assert r[1].orientation == pytest.approx(np.degrees(np.arctan2(vectors[1, 1], vectors[0, 1])) % 180)
    assert r[2].major is None and r[2].cx == 1.0


def test_empty_scores(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "k int, p double, o double")
    r = aggregates.contingency(df, ["k"], F.col("p") > 1, F.col("o") > 1).first()
    assert (r.csi, r.pod, r.far, r.f1) == (0, 0, 0, 0)
    assert aggregates.field_errors(df.union(df), ["k"], "p", "o").first()["corr"] is None
    assert aggregates.overlap(df, ["k"], F.col("p") > 1, F.col("o") > 1, F.lit(1.0)).first().iou is None
    assert aggregates.gini(df, ["k"], "p").first().gini is None


def test_retrieval_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, v[i].tolist(), i % 7) for i in range(300)], "id long, v array<double>, g long").repartition(5)
    got = retrieval.neighbours(df.where("id < 20"), df, "id", "id", "v", 15, group="g", exclude="group", block=7).collect()
    for t in range(20):
        d = ((v - v[t]) ** 2).sum(1)
        want = sorted((d[i], i) for i in range(300) if i % 7 != t % 7)[:15]
        found = sorted((r.distance, r.history_id) for r in got if r.target_id == t)
        assert [i for _, i in found] == [i for _, i in want] and [d for d, _ in found] == pytest.approx([d for d, _ in want])
    few = retrieval.diversified(retrieval.neighbours(df.where("id < 2"), df.where("g < 2"), "id", "id", "v", 40, group="g"), 20, 3)
    assert few.groupBy("target_id").count().where("count <> 20").isEmpty()  # the cap gives way
    w = retrieval.softmax_weights(few).groupBy("target_id").agg(F.sum("similarity_weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in w)
    use = retrieval.usable_features(spark.createDataFrame([(1, None)], "a int, b int"), spark.createDataFrame([(1, 1)], "a int, b int"), {"c": ["a", "b", "rain"]}, columns.LEAKS)
    assert use == {"c": ["a"]}


def test_eof(spark):
    rng = np.random.default_rng(2)
    fields = np.expm1(np.abs(rng.normal(size=(80, 3)) @ rng.normal(size=(3, 200))))
    df = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(fields)], "id long, f array<double>").repartition(4)
    basis = eof.fit(df, "f", rank=5, rounds=6)
    x = np.log1p(fields) - np.log1p(fields).mean(0)
    s = np.linalg.svd(x, compute_uv=False)
    assert basis.explained == pytest.approx((s**2 / (s**2).sum())[:5], rel=0.02)
    scores = {r.id: r.scores for r in eof.project(df, "f", "id", basis).collect()}
    assert scores[3] == pytest.approx(list(x[3] @ basis.components.T))
    r = {r.id: r for r in eof.reconstruct(df, "f", "id", basis, blend=0.0).collect()}
    assert r[5].f == pytest.approx(list(fields[5])) and 0 < r[5].rmse


def test_project_and_back(spark):
    """A field that is a plane comes back as that plane, wherever it reaches."""
    rel = grid.relative_grid(spark, 500.0, 50.0)
    fields = rel.select(F.lit("f").alias("frame"), "iy", "ix", (F.col("ahead") + 2 * F.col("left")).alias("rain"))
    track = spark.createDataFrame([("s", "f", 120.0, 20.0, 30.0)], "storm string, frame string, lon double, lat double, heading double")
    cells = grid.geographic_grid(track, ["storm"], 0.5, 3.0)
    out = grid.project_back(track, cells, fields, ["storm"], "frame", "rain", 500.0, 50.0, 0.5)
    e, n = geo.local_km(F.col("ilon") * 0.5, F.col("ilat") * 0.5, F.lit(120.0), F.lit(20.0))
    a, b = geo.to_storm_axes(e, n, F.lit(30.0))
    assert out.count() > 100 and out.where(F.abs(a + 2 * b - F.col("rain")) > 1e-6).isEmpty()


def test_to_relative(spark):
    raster = spark.range(81 * 81).select(F.lit("f").alias("frame"), F.floor(F.col("id") / 81).cast("long").alias("irow"), (F.col("id") % 81).alias("icol")).withColumn("rain", F.col("irow") * 1.0)
    frame = spark.createDataFrame([("f", 120.0, 20.0, 0.0, 116.0, 24.0, 0.1)], "frame string, lon double, lat double, heading double, lon0 double, lat0 double, cell_deg double")
    out = grid.to_relative(frame, raster, grid.relative_grid(spark, 200.0, 50.0), "frame", "rain").collect()
    assert len(out) == 81
    for r in out:
        assert r.rain == pytest.approx(40 - (r.ix * 50.0 - 200) / 11.132)
    assert grid.to_relative(frame.withColumn("lon0", F.lit(0.0)), raster, grid.relative_grid(spark, 200.0, 50.0), "frame", "rain").collect() == []


def test_calibration(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    t = spark.createDataFrame([(1, 120.0, 130.0, 140.0, 135.0, 30.0)], "k int, p95 double, p99 double, top double, cap double, want double")
    out = {r.v for r in calibration.scale_tail(df, t, "k", "v").collect()}
    assert max(out) == 135.0 and 50.0 in out
    same = calibration.match_area(df, t, "k", "v", F.lit(1.0), "want", 60.0)
    assert same.where("changed").count() == 5 and same.where("v >= 60").count() == 35
    capped = calibration.cap_targets(t.withColumns({"p99": F.lit(1.0), "top": F.lit(0.0)}), "p95", "p99", "top").first()
    assert (capped.p99, capped.top, capped.cap) == (120.0, 120.0, 120.0)


def test_scenarios(spark):
    base = spark.createDataFrame([("S", 0, 30.0, 990.0)], "id string, t int, wind double, pressure double")
    both = scenario.scenarios(base, {"S1": scenario.intensify(base, "wind", "pressure", 1.5, 40.0, -0.7)})
    assert {r.scenario_id: (r.wind, r.pressure) for r in both.collect()} == {"S0": (30.0, 990.0), "S1": (40.0, 983.0)}
    with pytest.raises(ValueError):
        scenario.intensify(base, "wind", "pressure", 1.5, 40.0, 0.7)
    assert scenario.reuse(base, base.withColumn("wind", F.lit(1.0)), ["id", "t"]).collect()[0].wind == 1.0
    path = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 3.0)], "k int, t int, lon double, lat double, v double")
    got = scenario.path_stretch(path, ["k"], ["t"], 50_000, ["v"]).orderBy("path_m").collect()
    assert [r.path_m for r in got] == [0, 50_000, 100_000] and got[1].v == pytest.approx(1 + 2 * 50 / 111.195, abs=1e-3)
    c = spark.createDataFrame([(1, 0.0, 0.0)], "k int, cx double, cy double")
    assert scenario.centroid_shift_km(c, c.withColumn("cx", F.lit(1.0)), ["k"]).first().shift_km == pytest.approx(111.195, abs=1e-2)


def test_guards(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    report = guards.rules(df, {"known": F.col("v").isNotNull(), "small": F.col("v") < 5})
    assert {r.rule: r.status for r in report.collect()} == {"known": "FAIL", "small": "FAIL"}
    with pytest.raises(columns.ContractError):
        guards.enforce(report)
    assert guards.enforce(guards.rules(df.na.drop(), {"known": F.col("v").isNotNull()})).count() == 1
    assert [r.x for r in spark.createDataFrame([(0.0,), (5.0,), (9.0,), (None,)], "v double").select(guards.verdict(F.col("v"), 4, 8).alias("x")).collect()] == ["PASS", "WARNING", "FAIL", "FAIL"]
    assert guards.statuses(spark.createDataFrame([("ok",), ("ok",)], "status string")).first().n == 2
    assert guards.agreement(df.withColumn("k", F.lit(1)).limit(1), df.withColumn("k", F.lit(2)).limit(1), ["k"], ["v"]).first().status == "warning"


def test_permutation(spark):
    df = spark.range(2000).select("id", (F.rand(1) * 10).alias("a"), F.rand(2).alias("b")).withColumn("y", 3 * F.col("a"))
    placed = stats._placed(df, F.xxhash64("id"), "id").select("__place").collect()
    assert sorted(r[0] for r in placed) == list(range(1, 2001))
    predict = stats.forest(df, ["a", "b"], "y", trees=5, depth=5, leaf=5)
    imp = {r.feature: r.importance for r in stats.permutation_importance(df, ["a", "b"], "y", predict, repeats=2, key="id").collect()}
    assert imp["a"] > 0.5 > abs(imp["b"])
    t = eof.templates(spark.createDataFrame([(i, i % 3, 1 + i % 4, 0.1 * i, i) for i in range(12)], "history_id long, g long, best_rank long, max_weight double, n long"), "g", 2, 5)
    assert t.count() == 5
