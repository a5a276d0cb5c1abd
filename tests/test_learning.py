"""Registries of derived columns, chains of fills, repeated validation, one-pass components."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainloom.functions.columns import ContractError
from rainloom.operators import eof, grouped, imputation, refresh, stats


def rule(name, inputs, outputs, log=None):
    def make(df):
        if log is not None:
            log.append(name)
        return df.withColumns({c: sum((F.col(i) for i in inputs[1:]), F.col(inputs[0])) for c in outputs})

    return refresh.Derived(name, tuple(inputs), tuple(outputs), make)


def test_refresh_makes_only_what_depends(spark):
    log = []
    r = refresh.Registry([rule("late", ["s", "t"], ["u"], log), rule("first", ["a"], ["s"], log), rule("second", ["b"], ["t"], log), rule("apart", ["c"], ["w"], log)])
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    full = r.refresh(df, df.columns)
    assert full.first().asDict() == {"a": 1, "b": 2, "c": 3, "u": 3, "s": 1, "t": 2, "w": 3} and log.index("late") > max(log.index("first"), log.index("second"))
    log.clear()
    out = r.refresh(full.withColumn("b", F.lit(10)).withColumn("w", F.lit(99)), ["b"]).first()
    assert log == ["second", "late"] and (out.t, out.u, out.s, out.w) == (10, 11, 1, 99)
    log.clear()
    assert r.refresh(full, ["unknown"]).first() == full.first() and log == []


def test_refresh_refuses_cycles_gaps_and_twins(spark):
    r = refresh.Registry([rule("x", ["q"], ["p"]), rule("y", ["p"], ["q"]), rule("z", ["a"], ["o"])])
    assert [d.name for d in r.order(["a"])] == ["z"]
    with pytest.raises(ContractError, match="x, y"):
        r.order(["p"])
    with pytest.raises(ContractError):
        refresh.Registry([rule("self", ["p"], ["p"])]).order(["p"])
    with pytest.raises(ContractError, match="twice"):
        refresh.Registry([rule("x", ["a"], ["p"]), rule("y", ["b"], ["p"])])
    with pytest.raises(ContractError, match="lacks b"):
        refresh.Registry([rule("x", ["a", "b"], ["p"])]).refresh(spark.range(1).toDF("a"), ["a"])


def test_track_features_follow_a_shift(spark):
    rows = [(1, f"2020-01-01 0{h}:00:00", 120.0 + h, 20.0, 30.0 + h * h, 1000.0 - h) for h in range(4)] + [(2, "2020-01-01 00:00:00", 130.0, 10.0, 20.0, 1005.0)]
    base = spark.createDataFrame(rows, "k int, t string, lon double, lat double, wind double, pressure double").select("k", F.col("t").cast("timestamp").alias("time"), "lon", "lat", "wind", "pressure")
    shore = spark.createDataFrame([("c", 119.0, 15.0, 119.0, 25.0)], "poly string, x1 double, y1 double, x2 double, y2 double")
    r = refresh.track_features(["k"], ["time"], shore, 900.0, refresh.baseline_scale(base))
    full = r.refresh(base, base.columns)
    one = {x.time.hour: x for x in full.where("k = 1").collect()}
    assert one[0].dt_h == 1 and one[0].move_speed == one[1].move_speed and [one[h].wind_rate for h in range(4)] == [1, 1, 3, 5]
    assert [one[h].intensifying for h in range(4)] == [True] * 4 and not one[1].weakening
    east = r.refresh(full.withColumn("lon", F.col("lon") + 1), ["lon"])
    two = {x.time.hour: x for x in east.where("k = 1").collect()}
    assert all(two[h].coast_km == pytest.approx(one[h].coast_km + 111.32 * math.cos(math.radians(20))) for h in range(4))
    assert all(two[h].move_speed == pytest.approx(one[h].move_speed) and two[h].intensity_index == one[h].intensity_index for h in range(4))
    single = full.where("k = 2").first()
    assert (single.dt_h, single.move_speed, single.life_progress, single.wind_rate, single.intensifying) == (None, None, 0, None, False)
    assert east.columns == full.columns


def test_imputation_sources_and_postcondition(spark):
    nan = float("nan")
    rows = [("a", 1, 1.0, 7.0), ("a", 2, None, 7.0), ("a", 4, 4.0, None), ("a", 5, nan, 2.0), ("b", 1, None, None), ("b", 2, float("inf"), 2.0), (None, 1, 9.0, 2.0), (None, 2, None, 5.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double")
    history = spark.createDataFrame([(10.0, None), (30.0, None), (nan, None)], "x double, y double")
    chains = {"x": [imputation.INTERPOLATED, imputation.GROUP_MEDIAN, imputation.HISTORY_MEDIAN], "y": [imputation.HISTORY_MEDIAN, imputation.MODE]}
    out = imputation.impute(df, history, ["k"], ["t"], chains, at=F.col("t"))
    got = {(r.k, r.t): (r.x, r.x_source, r.y, r.y_source) for r in out.collect()}
    assert got == {
        ("a", 1): (1, "own", 7, "own"), ("a", 2): (2, "interpolated", 7, "own"), ("a", 4): (4, "own", 2, "mode"), ("a", 5): (4, "interpolated", 2, "own"),
        ("b", 1): (20, "history_median", 2, "mode"), ("b", 2): (20, "history_median", 2, "own"), (None, 1): (9, "own", 2, "own"), (None, 2): (9, "interpolated", 5, "own"),
    }
    report = {(r.feature, r.source): r.n for r in imputation.fill_report(out, ["x", "y"]).collect()}
    assert report == {("x", "own"): 3, ("x", "interpolated"): 3, ("x", "history_median"): 2, ("y", "own"): 6, ("y", "mode"): 2}
    zero = imputation.impute(df.select("k", "t", F.lit(None).cast("double").alias("x")), history.limit(0), ["k"], ["t"], {"x": chains["x"]}).collect()
    assert {(r.x, r.x_source) for r in zero} == {(0, "zero")}
    assert imputation.impute(df.limit(0), history, ["k"], ["t"], chains).collect() == []
    with pytest.raises(ValueError, match="no such rule"):
        imputation.impute(df, history, ["k"], ["t"], {"x": ["guess"]})


def groups(spark, n=60):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(g, float(x), float(math.expm1(0.5 + 0.3 * x + 0.01 * rng.standard_normal()))) for g in range(n) for x in rng.random(8) * 10] + [(None, 1.0, 1.0), (1, None, 1.0), (1, 1.0, None)], "g int, x double, y double")


def test_splits_hold_out_whole_groups(spark):
    x = grouped.group_splits(groups(spark).dropna(), "g", 20, 0.25, seed=5)
    sides = x.groupBy("repeat", "g").agg(F.count_distinct("is_test").alias("n"), F.first("is_test").alias("t")).collect()
    assert len(sides) == 20 * 60 and {r.n for r in sides} == {1}
    held = {r: sum(s.t for s in sides if s.repeat == r) for r in range(1, 21)}
    assert 10 < statistics.mean(held.values()) < 20 and len({tuple(sorted(s.g for s in sides if s.repeat == r and s.t)) for r in held}) == 20
    assert "Exchange" not in grouped.group_splits(spark.range(5), "id")._jdf.queryExecution().executedPlan().toString()


def test_validation_of_logarithms_against_numpy(spark):
    df = groups(spark)
    draw = (F.col("g") * 7 + F.col("repeat") * 13) % 10 / 10.0
    got = {r.repeat: r for r in grouped.validate(df, "g", ["x"], "y", grouped.line_by_repeat, 3, 0.3, log=True, draw=draw).collect()}
    rows = [(r.g, r.x, r.y) for r in df.dropna().collect()]
    for k in (1, 2, 3):
        test = np.array([(g * 7 + k * 13) % 10 / 10 < 0.3 for g, _, _ in rows])
        x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        b, a = np.polyfit(x[~test], np.log1p(y[~test]), 1)
        p = np.expm1(a + b * x)
        assert (got[k].n_train, got[k].n_test, got[k].n_test_groups) == ((~test).sum(), test.sum(), 18)
        assert got[k].test_mae == pytest.approx(np.abs(y - p)[test].mean()) and got[k].baseline_rmse == pytest.approx(np.sqrt(((y - y[~test].mean())[test] ** 2).mean()))
        assert got[k].test_r2 == pytest.approx(1 - ((y - p)[test] ** 2).mean() / y[test].var()) and got[k].test_r2_model > 0.99
    s = grouped.summarise(grouped.validate(df, "g", ["x"], "y", grouped.line_by_repeat, 3, 0.3, log=True, draw=draw)).first()
    assert s.n_repeats == 3 and s.test_mae_std == pytest.approx(statistics.stdev(got[k].test_mae for k in got)) and s.mae_gain_pct > 50


def test_forests_by_repeat_beat_the_mean(spark):
    df = groups(spark, 24)
    s = grouped.summarise(grouped.validate(df, "g", ["x"], "y", grouped.forest_by_repeat(5, 5, 2), 2, log=True)).first()
    assert s.n_repeats == 2 and s.test_mae_mean < s.baseline_mae_mean and s.test_r2_mean > 0.8


@pytest.mark.parametrize("n,parts,batch", [(300, 6, 16), (20, 1, 128), (90, 40, 7)])
def test_one_pass_components_span_numpys(spark, n, parts, batch):
    rng = np.random.default_rng(n)
    logs = rng.random((n, 5)) @ rng.random((5, 40)) + 0.5
    df = spark.createDataFrame([(i, np.expm1(v).tolist()) for i, v in enumerate(logs)] + [(-1, None)], "k long, f array<double>").repartition(parts)
    basis = eof.fit_once(df, "f", rank=5, batch=batch, spare=3)
    centred = logs - logs.mean(0)
    _, sizes, vectors = np.linalg.svd(centred, full_matrices=False)
    angle = np.linalg.svd(basis.components @ vectors[:5].T)[1]
    assert np.allclose(basis.mean, logs.mean(0)) and np.arccos(np.minimum(angle, 1)).max() < 1e-6
    assert np.allclose(basis.explained, sizes[:5] ** 2 / (centred**2).sum()) and np.allclose(basis.components @ basis.components.T, np.eye(5))
    assert all(basis.components[np.arange(5), np.abs(basis.components).argmax(1)] > 0)


def test_one_pass_components_of_full_rank_fields(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("f")).repartition(4)
    basis = eof.fit_once(x, "f", rank=3, spare=61)  # 64 rows of 64 cells: nothing is dropped
    logs = np.log1p(np.array([r.f for r in x.collect()]))
    _, sizes, vectors = np.linalg.svd(logs - logs.mean(0), full_matrices=False)
    assert np.allclose(basis.explained, sizes[:3] ** 2 / (sizes**2).sum()) and np.allclose(np.abs((basis.components * vectors[:3]).sum(1)), 1)
    with pytest.raises(ValueError):
        eof.fit_once(x.limit(0), "f")


def test_forest_learns_from_condensed_rows(spark, monkeypatch):
    df = spark.range(6000).select("id", (F.col("id") % 6).cast("double").alias("a"), F.floor(F.rand(3) * 5).alias("b")).withColumn("y", 2 * F.col("a") + F.randn(5))
    few = stats.condense(df, ["a", "b"], "y", 4)
    s = few.selectExpr("count(*) AS rows", "sum(__weight) AS n", "sum(__weight * y) AS y").first()
    assert s.rows <= 6 * 5 * 4 and s.n == 6000 and s.y == pytest.approx(df.agg(F.sum("y")).first()[0])
    by_row = stats.forest(df, ["a", "b"], "y", trees=10, depth=5)(df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    monkeypatch.setattr(stats, "FEW", 100)
    predict = stats.forest(df, ["a", "b"], "y", trees=10, depth=5)
    assert predict(df).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] == pytest.approx(by_row, rel=0.02)


def test_importance_predicts_equal_rows_once(spark):
    df = spark.range(6000).select("id", (F.col("id") % 6).cast("double").alias("a"), (F.xxhash64("id") % 5).cast("double").alias("b")).withColumn("y", 3 * F.col("a"))
    predicted = spark.sparkContext.accumulator(0)

    def predict(x):
        def seen(frames):
            for f in frames:
                predicted.add(len(f))
                yield f.assign(prediction=3.0 * f["a"])

        return x.mapInPandas(seen, T.StructType([*x.schema, T.StructField("prediction", T.DoubleType())]))

    got = {r.feature: r.importance for r in stats.permutation_importance(df, ["a", "b"], "y", predict, repeats=3, key="id").collect()}
    assert predicted.value <= 54 + 3 * 2 * 54  # one a turn, feature and pair of values; there were 42000
    # the r2 of 3 a against itself at random is -1
    assert got["a"] == pytest.approx(2, abs=0.1) and got["b"] == 0
