"""Percentiles by bins and ranks by ranges against numpy, at both sides of their bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.operators import aggregates, selection, stats


def columns():
    rng = random.Random(8)
    inf = float("inf")
    return {
        "even": [rng.random() for _ in range(900)],
        "skewed": [math.exp(40 * rng.random()) for _ in range(700)] + [1e300, -1e300, 1.7e308, -1.7e308],
        "ties": [float(rng.randrange(3)) for _ in range(800)],
        "one": [5.0] * 400,
        "endless": [-inf] * 40 + [inf] * 50 + [rng.random() for _ in range(300)],
        "few": [3.0, 1.0, 2.0],
        "tiny": [5e-324 * i for i in range(300)],
        "gaps": [None] * 10 + [float("nan")] * 5,
        None: [float(i % 17) for i in range(500)],
    }


def frame(spark):
    rows = [(k, v) for k, vs in columns().items() for v in vs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


LEVELS = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("limit,bins", [(10, 8), (150, 16), (1, 4096), (1 << 20, 4096)])
def test_percentiles_by_bins_equal_numpys(spark, limit, bins):
    got = {r.k: r.q for r in selection.percentiles(frame(spark), ["k"], "v", LEVELS, limit=limit, bins=bins).collect()}
    assert set(got) == set(columns())
    for k, vs in columns().items():
        vs = sorted(v for v in vs if v is not None and not math.isnan(v))
        if not vs:
            assert got[k] is None
            continue
        for p, q in zip(LEVELS, got[k], strict=True):
            at = p * (len(vs) - 1)
            a, b = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
            assert q == a if a == b or at == int(at) else math.isinf(q) or q == pytest.approx(a + (b - a) * (at - int(at)))


def test_percentiles_of_a_whole_table(spark):
    x = frame(spark).where("k in ('even', 'ties')")
    want = np.percentile(columns()["even"] + columns()["ties"], [25, 50])
    for limit in (5, 10_000):
        (row,) = selection.percentiles(x, [], "v", (0.25, 0.5), limit=limit).collect()
        assert row.q == pytest.approx(list(want))
    assert selection.percentiles(x.limit(0), [], "v", (0.5,)).collect()[0].q is None
    assert selection.percentiles(x.limit(0), ["k"], "v", (0.5,)).collect() == []


def test_no_task_takes_a_large_group(spark):
    """Beyond the bound a group's rows are only counted by bin: no percentile runs over them."""
    x = spark.range(50_000).select(F.lit("a").alias("k"), (F.col("id") % 9973).cast("double").alias("v"))
    out = selection.percentiles(x, ["k"], "v", (0.5,), limit=1000)
    assert out.where("k = 'a'").first().q == [pytest.approx(np.median(np.arange(50_000) % 9973))]


def test_describe_and_scale_on_both_ways(spark, monkeypatch):
    x = frame(spark).where("k in ('even', 'ties', 'one') or k is null")
    few = {r.k: r for r in aggregates.describe(x, ["k"], "v").collect()}
    plain = selection.percentiles
    monkeypatch.setattr(selection, "percentiles", lambda *a, **b: plain(*a, **{**b, "limit": 20}))
    many = {r.k: r for r in aggregates.describe(x, ["k"], "v").collect()}
    assert set(few) == set(many) == {"even", "ties", "one", None}
    assert all(many[k][c] == pytest.approx(few[k][c]) for k in few for c in few[k].asDict() if c != "k")
    assert aggregates.robust_scale(x, ["v"]).first().median == pytest.approx(np.median([v for k in ("even", "ties", "one", None) for v in columns()[k]]))


def plain_ranks(vs):
    order = sorted(vs)
    return {v: (order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in set(vs)}


def test_percent_ranks_of_every_shape(spark):
    x = frame(spark).where("k is null or k not in ('gaps', 'few')")
    for by in ([], ["k"]):
        got = stats.percent_rank(x.where("k is not null") if by else x, by, "v", "p").collect()
        for k in {r.k for r in got} if by else [0]:
            vs = [r.v for r in got if not by or r.k == k]
            ranks = plain_ranks(vs)
            assert all(r.p == pytest.approx(ranks[r.v] / len(vs)) for r in got if not by or r.k == k)
    gaps = stats.percent_rank(frame(spark).where("k = 'gaps' and v is null"), [], "v", "p").collect()
    assert len(gaps) == 10 and all(r.p is None for r in gaps)


def test_spearman_ranks_counts_of_equal_pairs(spark, monkeypatch):
    ranged, ranges = [], selection.with_ranges
    monkeypatch.setattr(selection, "with_ranges", lambda df, *a: ranged.append(df.count()) or ranges(df, *a))
    df = spark.range(6000).select((F.col("id") % 6).alias("a"), (F.col("id") % 5).alias("b"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("c"))
    got = {(r.x, r.y): (r.rho, r.n) for r in stats.spearman(df, ["a"], ["b", "c", "a"]).collect()}
    assert set(got) == {("a", "b"), ("a", "c")} and got["a", "b"][1] == 6000 and got["a", "c"][1] == 3000 and ranged == [6 * 5 + 3]
    assert got["a", "b"][0] == pytest.approx(0, abs=1e-12)


def test_spearman_against_plain_ranks(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal(400)
    rows = [(float(v), float(v + rng.standard_normal()), float(round(v)), None if i % 5 == 0 else float(i % 3)) for i, v in enumerate(a)]
    got = {(r.x, r.y): (r.rho, r.n) for r in stats.spearman(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5), ["a", "b"], ["b", "c", "d"]).collect()}
    assert len(got) == 5
    for (x, y), (rho, n) in got.items():
        i, j = "abcd".index(x), "abcd".index(y)
        pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        u, v = (plain_ranks([p[k] for p in pairs]) for k in (0, 1))
        assert n == len(pairs) and rho == pytest.approx(np.corrcoef([u[p[0]] for p in pairs], [v[p[1]] for p in pairs])[0, 1])


def test_ranges_rise_with_values_and_are_even(spark):
    x = selection.with_ranges(frame(spark).where("v is not null and not isnan(v)"), ["v"], "_r").collect()
    pairs = sorted((r.v, r.v_r) for r in x)
    assert [p[1] for p in pairs] == sorted(p[1] for p in pairs)
    even = selection.with_ranges(spark.range(10_000).toDF("v"), ["v"], "_r").groupBy("v_r").count().agg(F.max("count"), F.count("*")).first()
    assert even[0] < 400 and even[1] > 40


def test_no_window_over_a_whole_column(spark):
    x = spark.range(1000).select((F.col("id") * 7 % 100).alias("v"), F.col("id"))
    plan = stats.percent_rank(x, [], "v", "p")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) >= 2 and all("__size" in w or "windowspecdefinition(v__r" in w for w in windows)  # over the ranges' totals, or within a range
