"""Aggregates over groups: exact statistics, weighted geometry of fields, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.clean import safe_ratio
from rainloom.operators import selection


def summary(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """mean, median, std (sample) and count of each value. A null key is a group."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.percentile(v, F.lit(0.5)).alias(f"{v}_median"), F.stddev_samp(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count")]
    return df.groupBy(*by).agg(*aggs)


def describe(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """count, mean, std, min, exact percentiles (linear between values) and max. Groups may be of any size."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = selection.percentiles(df, by, value, levels, "__q")
    q = q.select(*[F.col(c).alias(f"__q_{c}") for c in by], "__q")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__q_{c}"))
    x = out.join(q, same, "left") if by else out.join(F.broadcast(q))  # one row
    return x.select(*by, "n", "mean", "std", "min", *[F.col("__q")[i].alias(f"p{round(100 * q):02d}") for i, q in enumerate(levels)], "max")


def percentiles(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    out = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(q) for q in levels])).alias("__q"))
    return out.select(*by, *[F.col("__q")[i].alias(f"p{round(100 * q):02d}") for i, q in enumerate(levels)])


def missing_rate(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.col(v).isNull().cast("int")).alias(f"{v}_missing") for v in values])


def extremes(df: DataFrame, by: Sequence[str], value: str, row: str, order: Sequence[str]) -> DataFrame:
    """The `row` of the largest, the smallest and the absolutely smallest value, the first in order of several; nulls aside."""
    x = df.where(F.col(value).isNotNull())
    key = lambda c: F.struct(c, *order)
    return x.groupBy(*by).agg(F.min_by(row, key((-F.col(value)).alias("v"))).alias(f"max_{row}"), F.min_by(row, key(F.col(value).alias("v"))).alias(f"min_{row}"), F.min_by(row, key(F.abs(value).alias("v"))).alias(f"absmin_{row}"))


def modes(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value, the smallest of several."""
    return df.groupBy(*by).agg(F.mode(value, True).alias(f"{value}_mode"))


def votes(df: DataFrame, source: str, target: str) -> DataFrame:
    """Each source with the target it goes with most often (the smallest of several), and how often."""
    pairs = df.groupBy(source, target).agg(F.count("*").alias("votes"))
    return pairs.groupBy(source).agg(F.min(F.struct((-F.col("votes")).alias("v"), target)).alias("m")).select(source, f"m.{target}", (-F.col("m.v")).alias("votes"))


# -- weighted geometry -------------------------------------------------------------------------------------------------


def weighted(df: DataFrame, by: Sequence[str], x: str, y: str, w: str, least: int = 5) -> DataFrame:
    """Centroid and principal axes of weighted points: cx, cy, major and minor (square roots of the covariance's eigenvalues), orientation
    of the major axis in degrees [0, 180), axis_anisotropy and eigen_anisotropy, length and width (4 times the axes), aspect. Weights must
    be finite and positive, else the point is left out; axes need `least` points.

    The moments are taken about the groups' centroids, in a second aggregate: a difference of large sums would lose digits."""
    ok = df.where((F.col(w) > 0) & (F.col(w) < float("inf")) & F.col(x).isNotNull() & F.col(y).isNotNull())
    centre = ok.groupBy(*by).agg(F.sum(w).alias("total"), (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("cx"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("cy"), F.count("*").alias("n"))
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    m = ok.join(centre, list(by)).groupBy(*by, "total", "cx", "cy", "n").agg(*[(F.sum(F.col(w) * a * b) / F.col("total")).alias(k) for k, a, b in (("sxx", dx, dx), ("syy", dy, dy), ("sxy", dx, dy))])
    half, root = (F.col("sxx") + F.col("syy")) / 2, F.sqrt(F.pow((F.col("sxx") - F.col("syy")) / 2, 2) + F.pow("sxy", 2))
    enough = F.col("n") >= least
    m = m.withColumns({"major": F.when(enough, F.sqrt(half + root)), "minor": F.when(enough, F.sqrt(F.greatest(half - root, F.lit(0.0))))})
    angle = F.pmod(F.degrees(F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))) / 2 + 180, F.lit(180.0))
    a, b = F.col("major"), F.col("minor")
    return m.select(*by, "n", "total", "cx", "cy", "major", "minor", F.when(enough, angle).alias("orientation"), safe_ratio(a - b, a + b).alias("axis_anisotropy"), safe_ratio(a * a - b * b, a * a + b * b).alias("eigen_anisotropy"), (4 * a).alias("length"), (4 * b).alias("width"), safe_ratio(a, b).alias("aspect"))


def weighted_radius(df: DataFrame, by: Sequence[str], radius: str, w: str, levels: Sequence[float] = (0.5, 0.8, 0.9)) -> DataFrame:
    """The smallest radii within which the levels' shares of the weight lie. Points of one radius are summed first, so ties don't matter
    and a group of many points is small before it is ordered."""
    rings = df.where(F.col(w) > 0).groupBy(*by, radius).agg(F.sum(w).alias("__w"))
    part = Window.partitionBy(*by)
    rings = rings.withColumns({"__upto": F.sum("__w").over(part.orderBy(radius).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "__all": F.sum("__w").over(part)})
    return rings.groupBy(*by).agg(*[F.min(F.when(F.col("__upto") >= q * F.col("__all") * (1 - 1e-12), F.col(radius))).alias(f"r{round(100 * q)}") for q in levels])


def quadrants(df: DataFrame, by: Sequence[str], ahead: Column, left: Column, w: str, include_axis: bool = True) -> DataFrame:
    """Weight ahead and behind, left and right: sums, normalised asymmetries (A - B) / (A + B), and ratios A / B. include_axis: a point on an axis counts as ahead, or as left."""
    front, port = (ahead >= 0, left >= 0) if include_axis else (ahead > 0, left > 0)
    part = lambda c: F.sum(F.when(c, F.col(w)).otherwise(0.0))
    x = df.groupBy(*by).agg(part(front).alias("front"), part(ahead < 0).alias("rear"), part(port).alias("left"), part(left < 0).alias("right"), part(front & port).alias("front_left"), part(front & (left < 0)).alias("front_right"), part((ahead < 0) & port).alias("rear_left"), part((ahead < 0) & (left < 0)).alias("rear_right"))
    a = lambda p, q: safe_ratio(F.col(p) - F.col(q), F.col(p) + F.col(q))
    return x.withColumns({"front_asymmetry": a("front", "rear"), "left_asymmetry": a("left", "right"), "front_ratio": safe_ratio(F.col("front"), F.col("rear")), "left_ratio": safe_ratio(F.col("left"), F.col("right"))})


def threshold_areas(df: DataFrame, by: Sequence[str], value: str, area: Column, thresholds: Sequence[float]) -> DataFrame:
    """Area at or above each threshold, area of any rain (above 0.1, strictly), and the volume sum(value * area)."""
    aggs = [F.sum(F.when(F.col(value) >= t, area).otherwise(0.0)).alias(f"area_{t:g}") for t in thresholds]
    return df.groupBy(*by).agg(F.sum(F.when(F.col(value) > 0.1, area).otherwise(0.0)).alias("area_rain"), *aggs, F.sum(F.col(value) * area).alias("volume"))


def gini(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient of non-negative values. Equal values are counted first; their ranks follow from the counts."""
    x = df.where(F.col(value) >= 0).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    x = x.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranks = F.col("c") * (2 * F.col("upto") - F.col("c") + 1) / 2  # the sum of the ranks of c equal values
    out = x.groupBy(*by).agg(F.sum(ranks * F.col(value)).alias("s"), F.sum(F.col("c") * F.col(value)).alias("t"), F.sum("c").alias("n"))
    return out.select(*by, safe_ratio(2 * F.col("s") - (F.col("n") + 1) * F.col("t"), F.col("n") * F.col("t")).alias("gini"))


def entropy(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy of the values' shares over the log of the number of values (zeros count in it): with p = v / t it is log t - sum(v log v) / t."""
    v = F.col(value)
    x = df.where(v >= 0).groupBy(*by).agg(F.sum(v).alias("t"), F.sum(F.when(v > 0, v * F.log(v)).otherwise(0.0)).alias("s"), F.count("*").alias("n"))
    return x.select(*by, safe_ratio(F.log("t") - F.col("s") / F.col("t"), F.log("n")).alias("entropy"))


def nonzero(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    x = df.where(F.col(value) > 0)
    return x.groupBy(*by).agg(F.avg(value).alias("nonzero_mean"), F.percentile(value, F.lit(level)).alias(f"nonzero_p{round(100 * level)}"), F.count("*").alias("nonzero_n"))


def near_percentile(df: DataFrame, by: Sequence[str], value: str, level: float, row: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The percentile of the positive values, and the row whose value is nearest to it (the first in order of several)."""
    x = df.where(F.col(value) > 0)
    q = x.groupBy(*by).agg(F.percentile(value, F.lit(level)).alias("q"))
    return x.join(q, list(by)).groupBy(*by, "q").agg(F.min_by(F.struct(value, *row), F.struct(F.abs(F.col(value) - F.col("q")), *order)).alias("m")).select(*by, "q", "m.*")


# -- scales and supports -----------------------------------------------------------------------------------------------


def robust_scale(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """A row per value: median, scale (IQR, else the standard deviation, else 1) and missing rate."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values])).alias("s")).select("s.*")
    x = long.groupBy("feature").agg(F.stddev_samp("x").alias("std"), F.avg(F.col("x").isNull().cast("int")).alias("missing"))
    q = selection.percentiles(long, ["feature"], "x", (0.25, 0.5, 0.75))
    x = x.join(q, "feature").withColumns({"median": F.col("q")[1], "iqr": F.col("q")[2] - F.col("q")[0]})
    scale = F.when(F.col("iqr") > 1e-12, F.col("iqr")).when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)
    return x.select("feature", "median", scale.alias("scale"), "missing")


def standard_scale(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """A row per value: mean and population standard deviation, 1 where it all but vanishes."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values])).alias("s")).select("s.*")
    x = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return x.withColumn("std", F.when(F.col("std") <= 1e-12, 1.0).otherwise(F.col("std")))


def zscore(df: DataFrame, value: str, name: str) -> DataFrame:
    """value as a z-score within the whole table (sample deviation); 0 where all values are equal."""
    s = df.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))  # one row
    out = df.join(F.broadcast(s)).withColumn(name, F.coalesce(safe_ratio(F.col(value) - F.col("__m"), F.col("__s")), F.when(F.col(value).isNotNull(), F.lit(0.0))))
    return out.drop("__m", "__s")


def percentile_of_score(df: DataFrame, value: str, scores: Mapping[str, float]) -> DataFrame:
    """The share in percent of values that don't exceed each score."""
    aggs = [F.struct(F.lit(k).alias("score"), (F.avg((F.col(value) <= x).cast("int")) * 100).alias("percentile")) for k, x in scores.items()]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def support(history: DataFrame, target: DataFrame, values: Sequence[str]) -> DataFrame:
    """For each value the share of target rows outside the history's range, and its class: inside, edge (up to 5 %) or outside."""
    h = history.agg(*[f(v).alias(f"__{k}_{v}") for v in values for k, f in (("lo", F.min), ("hi", F.max))])
    x = target.join(F.broadcast(h))  # one row
    out = x.agg(F.array(*[F.struct(F.lit(v).alias("feature"), F.count(v).alias("n"), F.count_if((F.col(v) < F.col(f"__lo_{v}")) | (F.col(v) > F.col(f"__hi_{v}"))).alias("n_outside")) for v in values]).alias("a"))
    out = out.select(F.explode("a").alias("s")).select("s.*").withColumn("ratio", safe_ratio(F.col("n_outside").cast("double"), F.col("n").cast("double")))
    return out.withColumn("level", F.when(F.col("n_outside") == 0, "inside").when(F.col("ratio") <= 0.05, "edge").otherwise("outside"))


def tercile_edges(df: DataFrame, value: str) -> DataFrame:
    """The two edges that cut the values into terciles: one row."""
    return selection.percentiles(df, [], value, (1 / 3, 2 / 3)).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def terciles(df: DataFrame, value: str, name: str, labels: Sequence[str]) -> DataFrame:
    """Classes by the table's terciles, closed on the right."""
    out = df.join(F.broadcast(tercile_edges(df, value)))
    cls = F.when(F.col(value) <= F.col("lo"), labels[0]).when(F.col(value) <= F.col("hi"), labels[1]).when(F.col(value).isNotNull(), labels[2])
    return out.withColumn(name, cls).drop("lo", "hi")


# -- scores ------------------------------------------------------------------------------------------------------------


def field_errors(df: DataFrame, by: Sequence[str], predicted: str, truth: str) -> DataFrame:
    """rmse, mae, bias and Pearson correlation (null for constant fields) over the cells that have both."""
    x = df.where(F.col(predicted).isNotNull() & F.col(truth).isNotNull())
    d = F.col(predicted) - F.col(truth)
    # corr() of a constant field divides by zero: ask for spread on both sides
    spread = (F.stddev_pop(predicted) > 1e-12) & (F.stddev_pop(truth) > 1e-12)
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.when(spread, F.covar_pop(predicted, truth) / (F.stddev_pop(predicted) * F.stddev_pop(truth))).alias("corr"))


def contingency(df: DataFrame, by: Sequence[str], predicted: Column, observed: Column, eps: float = 1e-12) -> DataFrame:
    """hits, misses, false alarms; csi, pod, far and f1, 0 where nothing was predicted or observed."""
    p, o = F.coalesce(predicted, F.lit(False)), F.coalesce(observed, F.lit(False))
    x = df.groupBy(*by).agg(F.count_if(p & o).alias("hits"), F.count_if(~p & o).alias("misses"), F.count_if(p & ~o).alias("false_alarms"))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return x.withColumns({"csi": h / (h + m + f + eps), "pod": h / (h + m + eps), "far": f / (h + f + eps), "f1": 2 * h / (2 * h + m + f + eps)})


def overlap(df: DataFrame, by: Sequence[str], one: Column, other: Column, area: Column) -> DataFrame:
    """Area-weighted intersection over union of two masks, null if both are empty."""
    x = df.groupBy(*by).agg(F.sum(F.when(one & other, area).otherwise(0.0)).alias("both"), F.sum(F.when(one | other, area).otherwise(0.0)).alias("either"))
    return x.select(*by, safe_ratio(F.col("both"), F.col("either")).alias("iou"))


def mean_of_means(df: DataFrame, inner: Sequence[str], outer: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each outer group's mean and median of its inner groups' means: every inner group weighs the same."""
    x = df.groupBy(*{*inner, *outer}).agg(*[F.avg(v).alias(v) for v in values])
    return x.groupBy(*outer).agg(F.count("*").alias("n_groups"), *[a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.percentile(v, F.lit(0.5)).alias(f"{v}_median"))])


def line(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Least-squares line with as many points, and a spread of x, at the least."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = (F.count("*") >= least) & (F.stddev_pop(x) > 1e-12)
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.when(fit, F.regr_slope(y, x)).alias("slope"), F.when(fit, F.regr_intercept(y, x)).alias("intercept"))


def stability(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Values scaled to [0, 1] over the table and summed: score; is_best marks the least. df has a row a setting, so it is small."""
    lohi = df.agg(*[f(v).alias(f"__{k}_{v}") for v in values for k, f in (("lo", F.min), ("hi", F.max))])
    x = df.join(F.broadcast(lohi))
    part = lambda v: F.coalesce(safe_ratio(F.col(v) - F.col(f"__lo_{v}"), F.col(f"__hi_{v}") - F.col(f"__lo_{v}")), F.lit(0.0))
    score = sum((part(v) for v in values[1:]), part(values[0]))
    x = x.select(*df.columns, score.alias("score"))
    best = x.agg(F.min_by(key, F.struct("score", key)).alias("__best"))
    return x.join(F.broadcast(best)).withColumn("is_best", F.col(key) == F.col("__best")).drop("__best")


def against_baseline(df: DataFrame, key: str, baseline: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """<v>_delta and <v>_pct against the row whose key is the baseline (percent null if its value all but vanishes)."""
    base = df.where(F.col(key) == baseline).select(*by, *[F.col(v).alias(f"__b_{v}") for v in values])
    x = df.join(base, list(by), "left") if by else df.join(F.broadcast(base), how="left")  # one row
    out = {}
    for v in values:
        out[f"{v}_delta"] = F.col(v) - F.col(f"__b_{v}")
        out[f"{v}_pct"] = safe_ratio((F.col(v) - F.col(f"__b_{v}")) * 100, F.col(f"__b_{v}"))
    return x.withColumns(out).drop(*[f"__b_{v}" for v in values])


def field_quality(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Counts of missing, not-a-number, infinite and negative cells, and whether all are zero."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"), F.count_if(v < 0).alias("n_negative"), F.coalesce(F.bool_and(v == 0), F.lit(False)).alias("all_zero"))
