"""Metric bundles and ablations on cases whose answers are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.operators import retrieval, verification


def cells(spark, fields):
    """Rows (f, x, y, t, a, b) of fields given as {f: [(x, y, t, a, b), ...]}."""
    rows = [(f, float(x), float(y), *[None if v is None else float(v) for v in vs]) for f, cs in fields.items() for x, y, *vs in cs]
    return spark.createDataFrame(rows, "f long, x double, y double, t double, a double, b double")


def test_metrics_of_known_fields(spark):
    square = [(100, 100, 10, 10, 0), (100, -100, 0, 0, 10), (-100, 100, 0, 0, 0), (-100, -100, 0, 0, None)]
    nan = float("nan")
    fields = {1: square, 2: [(x, y, 0, 0, 0) for x, y, *_ in square], 3: [(0, 0, nan, 1, None)], 4: [(0, 0, None, None, None)]}
    out = {(r.f, r.version): r for r in verification.field_metrics(cells(spark, fields), ["f"], "t", {"one": "a", "two": "b"}, "x", "y", 2.0, (1, 10)).collect()}
    assert len(out) == 8
    same, other = out[1, "one"], out[1, "two"]
    assert (same.rmse, same.mae, same.bias, same.corr, same.csi_10, same.max_error, same.centroid_error) == (0, 0, 0, pytest.approx(1), pytest.approx(1), 0, 0)
    assert (same.centroid_x, same.centroid_y, same.r90, same.area_10, same.share_10, same.front_left_share) == (100, 100, pytest.approx(math.hypot(100, 100)), 2, 0.25, 1)
    assert same.anisotropy is None and same.front_back is None and same.band_width == 0
    assert (other.n_both, other.mae, other.csi_10, other.far_10, other.pod_10, other.centroid_error) == (3, pytest.approx(20 / 3), 0, pytest.approx(1), 0, 200)
    dry, missing, none = out[2, "one"], out[3, "one"], out[4, "one"]
    assert (dry.mean, dry.max, dry.rmse, dry.corr, dry.centroid_x, dry.r50, dry.csi_1, dry.max_relative_error) == (0, 0, 0, None, None, None, 0, None)
    assert (missing.n_both, missing.rmse, missing.max, missing.truth_max, missing.max_error) == (0, None, 1, None, None)
    assert (none.mean, none.rmse, none.area_1) == (None, None, 0)


def test_one_shuffle_for_all_versions(spark):
    x = cells(spark, {1: [(0, 0, 1, 1, 1)]})
    plan = verification.field_metrics(x, ["f"], "t", {"one": "a", "two": "b"}, "x", "y", 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def vectors(spark, n=240, seed=0):
    """Places 0-3 of the vector tell the field, 4-7 are noise ten times as large."""
    rng = np.random.default_rng(seed)
    told, noise = rng.random((n, 4)), rng.random((n, 4)) * 10
    rows = [(i, [*map(float, a), *map(float, b)], [float(20 * a.sum() * (j + 1) / 10) for j in range(5)], i % 12) for i, (a, b) in enumerate(zip(told, noise, strict=True))]
    return spark.createDataFrame(rows, "id long, v array<double>, field array<double>, g long").repartition(5)


def test_ablation_prefers_the_features_that_tell(spark):
    x = vectors(spark)
    modes = {"told": {"a": (slice(0, 4), 1.0)}, "noise": {"b": ([4, 5, 6, 7], 1.0)}, "both": {"a": (slice(0, 4), 1.0), "b": (slice(4, 8), 1.0)}}
    out = verification.ablation(x.where("id % 10 = 0"), x, "id", "v", "field", modes, [(i * 10, -i * 10) for i in range(5)], 1.0, ["rmse", "mae"], ["csi_10"], "g", pool=60).collect()
    best = {r["mode"]: r for r in out}
    assert {m: r.n_targets for m, r in best.items()} == dict.fromkeys(modes, 24)
    assert [m for m, r in best.items() if r.is_best] == ["told"] and best["told"].rmse < best["both"].rmse and best["told"].score == 0


def test_modes_are_single_searches(spark):
    x = vectors(spark, 150, 1)
    modes = {"a": {"p": (slice(0, 4), 2.0)}, "b": {"p": (slice(0, 4), 1.0), "q": ([7, 5], 0.5)}, "all": None}
    t = x.where("id % 10 = 0")
    got = {(r["mode"], r.target_id, r.history_id): r.distance for r in retrieval.neighbours_by_mode(t, x, "id", "id", "v", 7, modes, "g", "group", block=9).collect()}
    for m, parts in modes.items():
        one = {(m, r.target_id, r.history_id): r.distance for r in retrieval.neighbours(t, x, "id", "id", "v", 7, parts, "g", "group").collect()}
        assert len(one) == 15 * 7 and one == {k: v for k, v in got.items() if k[0] == m}
    rows = {r.id: (np.array(r.v), r.g) for r in x.collect()}
    want = sorted(((((rows[h][0] - rows[0][0])[[7, 5]] ** 2).sum() * 0.25 + ((rows[h][0] - rows[0][0])[:4] ** 2).sum() / 4), h) for h in rows if rows[h][1] != rows[0][1])[:7]
    assert sorted((d, h) for (m, t, h), d in got.items() if m == "b" and t == 0) == [(pytest.approx(d), h) for d, h in want]


def test_one_scan_of_history(spark):
    x = vectors(spark, 50)
    found = retrieval.neighbours_by_mode(x.where("id < 5"), x, "id", "id", "v", 3, {"a": {"p": (slice(0, 4), 1.0)}, "b": {"p": (slice(4, 8), 1.0)}, "c": None})
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_choice_without_spread_or_values(spark):
    x = spark.createDataFrame([("a", 1.0, 5.0, None), ("b", 1.0, 7.0, None)], "k string, e double, s double, z double")
    out = {r.k: r for r in verification.choose(x, "k", ["e", "z"], ["s"]).collect()}
    assert (out["a"].score, out["b"].score, out["b"].is_best) == (1, 0, True)
    out = {r.k: r for r in verification.choose(x, "k", ["e"], []).collect()}
    assert (out["a"].is_best, out["b"].is_best) == (True, False)
    assert verification.choose(x.where(F.lit(False)), "k", ["e"]).collect() == []
