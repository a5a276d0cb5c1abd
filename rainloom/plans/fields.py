"""Queries on fields: a supplier's line items are the cells of a field, price is weight, quantity and discount are coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.functions import geo
from rainloom.operators import aggregates as ag
from rainloom.operators import calibration, grid, guards, stats
from rainloom.plans.registry import query, rounded, table

FIELD = ["l_suppkey"]


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("""
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) + 0.0 AS l_quantity_mean, round(quantile_cont(l_quantity, 0.5), 6) + 0.0 AS l_quantity_median, round(stddev_samp(l_quantity), 6) + 0.0 AS l_quantity_std, count(l_quantity) AS l_quantity_count,
  round(avg(l_discount), 6) + 0.0 AS l_discount_mean, round(quantile_cont(l_discount, 0.5), 6) + 0.0 AS l_discount_median, round(stddev_samp(l_discount), 6) + 0.0 AS l_discount_std, count(l_discount) AS l_discount_count
FROM lineitem GROUP BY ALL
""")
def group_mean_median_std(spark, sf_dir):
    return rounded(ag.summary(items(spark, sf_dir), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"]))


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min,
  round(quantile_cont(value, 0.1), 6) + 0.0 AS p10, round(quantile_cont(value, 0.25), 6) + 0.0 AS p25, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.75), 6) + 0.0 AS p75, round(quantile_cont(value, 0.9), 6) + 0.0 AS p90, round(max(value), 6) + 0.0 AS max
FROM events GROUP BY event_type
""")
def describe_exact(spark, sf_dir):
    return rounded(ag.describe(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("SELECT event_type, round(avg((event_id % 7 = 0)::INT), 6) + 0.0 AS value_missing FROM events GROUP BY event_type")
def missing_rate(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return rounded(ag.missing_rate(x, ["event_type"], ["value"]))


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY abs(value), ts, event_id) AS c FROM events)
SELECT user_id, max(event_id) FILTER (a = 1) AS max_event_id, max(event_id) FILTER (b = 1) AS min_event_id, max(event_id) FILTER (c = 1) AS absmin_event_id FROM x GROUP BY user_id
""")
def argmax_rows(spark, sf_dir):
    return ag.extremes(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", ["ts", "event_id"])


@query("SELECT o_orderstatus, mode(o_orderpriority ORDER BY o_orderpriority) AS o_orderpriority_mode FROM orders GROUP BY o_orderstatus")
def mode_by_group(spark, sf_dir):
    return ag.modes(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority")


@query("""
WITH p AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS n FROM p)
SELECT user_id, event_type, votes FROM x WHERE n = 1
""")
def event_vote_map(spark, sf_dir):
    return ag.votes(table(spark, sf_dir, "events"), "user_id", "event_type")


MOMENTS = """
WITH c AS (SELECT l_suppkey, sum(l_extendedprice) AS t, sum(l_extendedprice * l_quantity) / sum(l_extendedprice) AS cx, sum(l_extendedprice * l_discount * 100) / sum(l_extendedprice) AS cy, count(*) AS n FROM lineitem WHERE %s GROUP BY l_suppkey),
m AS (SELECT l_suppkey, t, cx, cy, n, sum(l_extendedprice * (l_quantity - cx) ** 2) / t AS sxx, sum(l_extendedprice * (l_discount * 100 - cy) ** 2) / t AS syy, sum(l_extendedprice * (l_quantity - cx) * (l_discount * 100 - cy)) / t AS sxy
      FROM lineitem JOIN c USING (l_suppkey) WHERE %s GROUP BY l_suppkey, t, cx, cy, n),
e AS (SELECT *, CASE WHEN n >= 5 THEN sqrt((sxx + syy) / 2 + sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2)) END AS a, CASE WHEN n >= 5 THEN sqrt(greatest((sxx + syy) / 2 - sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2), 0)) END AS b,
      CASE WHEN n >= 5 THEN (degrees(atan2(2 * sxy, sxx - syy)) / 2 + 180) %% 180 END AS o FROM m)
"""


def shape(df):
    return ag.weighted(df.withColumns({"x": F.col("l_quantity"), "y": F.col("l_discount") * 100}), FIELD, "x", "y", "l_extendedprice")


@query(MOMENTS % ("true", "true") + "SELECT l_suppkey, n, round(t, 2) + 0.0 AS total, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy FROM e")
def weighted_centroid(spark, sf_dir):
    return rounded(shape(items(spark, sf_dir)).select("l_suppkey", "n", F.round("total", 2).alias("total"), "cx", "cy"))


@query(MOMENTS % ("true", "true") + "SELECT l_suppkey, round(a, 6) + 0.0 AS major, round(b, 6) + 0.0 AS minor, round(o, 4) + 0.0 AS orientation, round((a - b) / nullif(a + b, 0), 6) + 0.0 AS axis_anisotropy, round((a * a - b * b) / nullif(a * a + b * b, 0), 6) + 0.0 AS eigen_anisotropy FROM e")
def weighted_anisotropy(spark, sf_dir):
    x = shape(items(spark, sf_dir)).select("l_suppkey", "major", "minor", F.round("orientation", 4).alias("orientation"), "axis_anisotropy", "eigen_anisotropy")
    return rounded(x)


@query(MOMENTS % ("l_extendedprice >= 50000", "l_extendedprice >= 50000") + "SELECT l_suppkey, round(4 * a, 6) + 0.0 AS length, round(4 * b, 6) + 0.0 AS width, CASE WHEN b > 1e-12 THEN round(a / b, 6) + 0.0 END AS aspect FROM e")
def band_width(spark, sf_dir):
    return rounded(shape(items(spark, sf_dir).where("l_extendedprice >= 50000")).select("l_suppkey", "length", "width", "aspect"))


@query("""
WITH r AS (SELECT l_suppkey, l_quantity, sum(l_extendedprice) AS w FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_quantity ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM r)
SELECT l_suppkey, min(l_quantity) FILTER (upto >= 0.5 * t * (1 - 1e-12)) AS r50, min(l_quantity) FILTER (upto >= 0.8 * t * (1 - 1e-12)) AS r80, min(l_quantity) FILTER (upto >= 0.9 * t * (1 - 1e-12)) AS r90 FROM c GROUP BY l_suppkey
""")
def weighted_radius(spark, sf_dir):
    return rounded(ag.weighted_radius(items(spark, sf_dir), FIELD, "l_quantity", "l_extendedprice"))


@query("""
WITH x AS (SELECT *, (l_quantity - 25) * sin(radians(l_tax * 1000)) + (l_discount * 100 - 5) * cos(radians(l_tax * 1000)) AS a, -(l_quantity - 25) * cos(radians(l_tax * 1000)) + (l_discount * 100 - 5) * sin(radians(l_tax * 1000)) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(a, 6) + 0.0 AS ahead, round(b, 6) + 0.0 AS left_km, round(sqrt(a * a + b * b), 6) + 0.0 AS distance FROM x
""")
def storm_relative(spark, sf_dir):
    a, b = geo.to_storm_axes(F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5, F.col("l_tax") * 1000)
    return rounded(items(spark, sf_dir).select("l_orderkey", "l_linenumber", a.alias("ahead"), b.alias("left_km"), F.sqrt(a * a + b * b).alias("distance")))


@query("""
WITH x AS (SELECT l_suppkey, l_extendedprice AS w, l_quantity - 25 AS a, l_discount * 100 - 5.5 AS b FROM lineitem),
s AS (SELECT l_suppkey, sum(w) FILTER (a >= 0) AS f, sum(w) FILTER (a < 0) AS r, sum(w) FILTER (b >= 0) AS l, sum(w) FILTER (b < 0) AS g, sum(w) FILTER (a >= 0 AND b >= 0) AS fl FROM x GROUP BY l_suppkey)
SELECT l_suppkey, round(coalesce(fl, 0), 2) + 0.0 AS front_left, round((coalesce(f, 0) - coalesce(r, 0)) / (coalesce(f, 0) + coalesce(r, 0)), 6) + 0.0 AS front_asymmetry, round((coalesce(l, 0) - coalesce(g, 0)) / (coalesce(l, 0) + coalesce(g, 0)), 6) + 0.0 AS left_asymmetry, round(coalesce(f, 0) / nullif(r, 0), 6) + 0.0 AS front_ratio FROM s
""")
def quadrant_asymmetry(spark, sf_dir):
    x = ag.quadrants(items(spark, sf_dir), FIELD, F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5.5, "l_extendedprice")
    return rounded(x.select("l_suppkey", F.round("front_left", 2).alias("front_left"), "front_asymmetry", "left_asymmetry", "front_ratio"))


@query("""
WITH x AS (SELECT l_suppkey, l_quantity AS v, 100 * cos(radians(l_discount * 100)) AS area FROM lineitem)
SELECT l_suppkey, round(coalesce(sum(area) FILTER (v > 0.1), 0), 4) + 0.0 AS area_rain, round(coalesce(sum(area) FILTER (v >= 1), 0), 4) + 0.0 AS area_1, round(coalesce(sum(area) FILTER (v >= 10), 0), 4) + 0.0 AS area_10, round(coalesce(sum(area) FILTER (v >= 20), 0), 4) + 0.0 AS area_20, round(sum(v * area), 2) + 0.0 AS volume FROM x GROUP BY l_suppkey
""")
def threshold_area(spark, sf_dir):
    x = ag.threshold_areas(items(spark, sf_dir), FIELD, "l_quantity", 100 * F.cos(F.radians(F.col("l_discount") * 100)), [1, 10, 20])
    return x.select("l_suppkey", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("area_rain", "area_1", "area_10", "area_20")], (F.round("volume", 2) + F.lit(0.0)).alias("volume"))


@query("SELECT l_suppkey, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) + 0.0 AS p{round(100 * q)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM lineitem GROUP BY l_suppkey")
def percentile_bundle(spark, sf_dir):
    x = ag.percentiles(items(spark, sf_dir), FIELD, "l_extendedprice", (0.5, 0.75, 0.9, 0.95, 0.99))
    return x.select("l_suppkey", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in x.columns[1:]])


@query("""
WITH x AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, round((2 * sum(i * v) - (max(n) + 1) * sum(v)) / (max(n) * sum(v)), 6) + 0.0 AS gini FROM x GROUP BY l_suppkey
""")
def gini(spark, sf_dir):
    return rounded(ag.gini(items(spark, sf_dir), FIELD, "l_extendedprice"))


@query("""
WITH x AS (SELECT l_suppkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_suppkey) AS p, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, CASE WHEN max(n) > 1 THEN round(-sum(p * ln(p)) / ln(max(n)), 6) + 0.0 END AS entropy FROM x GROUP BY l_suppkey
""")
def entropy_norm(spark, sf_dir):
    return rounded(ag.entropy(items(spark, sf_dir), FIELD, "l_extendedprice"))


@query("""
WITH x AS (SELECT l_suppkey, CASE WHEN l_discount >= 0.03 THEN l_quantity ELSE 0 END AS v FROM lineitem)
SELECT l_suppkey, round(avg(v), 6) + 0.0 AS nonzero_mean, round(quantile_cont(v, 0.95), 6) + 0.0 AS nonzero_p95, count(*) AS nonzero_n FROM x WHERE v > 0 GROUP BY l_suppkey
""")
def nonzero_stats(spark, sf_dir):
    x = items(spark, sf_dir).withColumn("v", F.when(F.col("l_discount") >= 0.03, F.col("l_quantity")).otherwise(0.0))
    return rounded(ag.nonzero(x, FIELD, "v"))


@query("""
WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.99) AS q FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL),
x AS (SELECT l.*, q, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_extendedprice - q), l_orderkey, l_partkey, l_linenumber) AS n FROM lineitem l JOIN q USING (l_suppkey))
SELECT l_suppkey, round(q, 4) + 0.0 AS q, round(l_extendedprice, 4) + 0.0 AS l_extendedprice, l_orderkey FROM x WHERE n = 1
""")
def nearest_to_p99(spark, sf_dir):
    x = ag.near_percentile(items(spark, sf_dir), FIELD, "l_extendedprice", 0.99, ["l_orderkey"], ["l_orderkey", "l_partkey", "l_linenumber"])
    return x.select("l_suppkey", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("q", "l_extendedprice")], "l_orderkey")


@query("""
WITH x AS (UNPIVOT (SELECT l_quantity, l_discount, l_tax, CASE WHEN l_linenumber > 2 THEN 1.0::DOUBLE END AS l_flat FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME feature VALUE x),
n AS (SELECT avg((l_linenumber <= 2)::INT) AS m FROM lineitem),
s AS (SELECT feature, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, stddev_samp(x) AS sd FROM x GROUP BY feature)
SELECT feature, round(med, 6) + 0.0 AS median, round(CASE WHEN iqr > 1e-12 THEN iqr WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) + 0.0 AS scale, 0.0::DOUBLE AS missing FROM s
UNION ALL SELECT 'l_flat', 1.0, 1.0, round((SELECT m FROM n), 6) + 0.0
""")
def robust_scaler(spark, sf_dir):
    x = items(spark, sf_dir).withColumn("l_flat", F.when(F.col("l_linenumber") > 2, 1.0))
    return rounded(ag.robust_scale(x, ["l_quantity", "l_discount", "l_tax", "l_flat"]))


@query("SELECT 'd' || i AS feature, round(avg(embedding[i + 1]::DOUBLE), 6) + 0.0 AS mean, round(stddev_pop(embedding[i + 1]::DOUBLE), 6) + 0.0 AS std FROM embeddings, range(8) r(i) GROUP BY i")
def standardise(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(8)])
    return rounded(ag.standard_scale(x, [f"d{i}" for i in range(8)]))


@query("""
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d, avg(100 - value) AS m2, stddev_samp(100 - value) AS d2 FROM events)
SELECT event_id, round(0.5 * (value - m) / d + 0.5 * ((100 - value) / 2 - m2 / 2) / (d2 / 2), 6) + 0.0 AS intensity_index FROM events, s
""")
def intensity_index(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("deficit", (100 - F.col("value")) / 2)
    x = ag.zscore(ag.zscore(x, "value", "z1"), "deficit", "z2")
    return rounded(x.select("event_id", (0.5 * F.col("z1") + 0.5 * F.col("z2")).alias("intensity_index")))


@query("""
SELECT 'low' AS score, round(100 * avg((o_totalprice <= 50000)::INT), 6) + 0.0 AS percentile FROM orders UNION ALL SELECT 'high', round(100 * avg((o_totalprice <= 400000)::INT), 6) + 0.0 FROM orders
""")
def percentile_of_score(spark, sf_dir):
    return rounded(ag.percentile_of_score(table(spark, sf_dir, "orders"), "o_totalprice", {"low": 50000, "high": 400000}))


@query("""
WITH h AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, min(o_custkey) AS c, max(o_custkey) AS d FROM orders WHERE o_orderstatus = 'F'),
t AS (SELECT count(o_totalprice) AS n, count(*) FILTER (o_totalprice < a OR o_totalprice > b) AS k, count(*) FILTER (o_custkey < c OR o_custkey > d) AS l FROM orders, h WHERE o_orderstatus <> 'F'),
u AS (SELECT 'o_totalprice' AS feature, n, k AS n_outside FROM t UNION ALL SELECT 'o_custkey', n, l FROM t)
SELECT feature, n, n_outside, round(n_outside / n::DOUBLE, 6) + 0.0 AS ratio, CASE WHEN n_outside = 0 THEN 'inside' WHEN n_outside / n::DOUBLE <= 0.05 THEN 'edge' ELSE 'outside' END AS level FROM u
""")
def support_audit(spark, sf_dir):
    x = table(spark, sf_dir, "orders")
    return rounded(ag.support(x.where("o_orderstatus = 'F'"), x.where("o_orderstatus <> 'F'"), ["o_totalprice", "o_custkey"]))


@query("""
SELECT l_returnflag, count(*) AS n, round(sqrt(avg((l_extendedprice - 1400 * l_quantity) ** 2)), 4) + 0.0 AS rmse, round(avg(abs(l_extendedprice - 1400 * l_quantity)), 4) + 0.0 AS mae, round(avg(l_extendedprice - 1400 * l_quantity), 4) + 0.0 AS bias, round(corr(l_extendedprice, l_quantity), 6) + 0.0 AS corr
FROM lineitem GROUP BY l_returnflag
""")
def field_corr_errors(spark, sf_dir):
    x = ag.field_errors(items(spark, sf_dir).withColumn("truth", 1400 * F.col("l_quantity")), ["l_returnflag"], "l_extendedprice", "truth")
    return rounded(x.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "bias")], "corr"))


@query("""
WITH x AS (SELECT doc_id % 3 AS g, count(*) FILTER (quality = 0 AND toxic = 1) AS hits, count(*) FILTER (quality = 1 AND toxic = 1) AS misses, count(*) FILTER (quality = 0 AND toxic = 0) AS false_alarms FROM labels GROUP BY ALL)
SELECT g, hits, misses, false_alarms, round(hits / (hits + misses + false_alarms + 1e-12), 6) + 0.0 AS csi, round(hits / (hits + misses + 1e-12), 6) + 0.0 AS pod, round(false_alarms / (hits + false_alarms + 1e-12), 6) + 0.0 AS far, round(2 * hits / (2 * hits + misses + false_alarms + 1e-12), 6) + 0.0 AS f1 FROM x
""")
def contingency(spark, sf_dir):
    x = table(spark, sf_dir, "labels").withColumn("g", F.col("doc_id") % 3)
    return rounded(ag.contingency(x, ["g"], F.col("quality") == 0, F.col("toxic") == 1))


@query("""
WITH x AS (SELECT l_suppkey, l_quantity AS area, l_discount >= 0.05 AS a, l_tax >= 0.04 AS b FROM lineitem)
SELECT l_suppkey, round(coalesce(sum(area) FILTER (a AND b), 0) / sum(area) FILTER (a OR b), 6) + 0.0 AS iou FROM x GROUP BY l_suppkey
""")
def iou(spark, sf_dir):
    return rounded(ag.overlap(items(spark, sf_dir), FIELD, F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04, F.col("l_quantity")))


@query("""
WITH x AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL)
SELECT event_type, count(*) AS n_groups, round(avg(v), 6) + 0.0 AS value_mean, round(quantile_cont(v, 0.5), 6) + 0.0 AS value_median FROM x GROUP BY event_type
""")
def mean_of_means(spark, sf_dir):
    return rounded(ag.mean_of_means(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], ["value"]))


@query("""
SELECT o_orderstatus, count(*) AS n, round(regr_slope(o_totalprice, o_custkey), 6) + 0.0 AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) + 0.0 AS intercept FROM orders GROUP BY o_orderstatus
""")
def linear_fit(spark, sf_dir):
    x = ag.line(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_custkey", "o_totalprice")
    return rounded(x.withColumn("intercept", F.round("intercept", 4)))


SETTINGS = "SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, count(*)::DOUBLE AS c FROM events GROUP BY event_type"


def settings(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").cast("double").alias("c"))


@query(f"""
WITH x AS ({SETTINGS}), y AS (SELECT event_type, coalesce((m - min(m) OVER ()) / nullif(max(m) OVER () - min(m) OVER (), 0), 0) + coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), 0) + coalesce((c - min(c) OVER ()) / nullif(max(c) OVER () - min(c) OVER (), 0), 0) AS score FROM x)
SELECT event_type, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY score, event_type) = 1 AS is_best FROM y
""")
def stability_score(spark, sf_dir):
    return rounded(ag.stability(settings(spark, sf_dir), "event_type", ["m", "s", "c"]).select("event_type", "score", "is_best"))


@query(f"""
WITH x AS ({SETTINGS}), b AS (SELECT * FROM x WHERE event_type = 'view')
SELECT x.event_type, round(x.m - b.m, 6) + 0.0 AS m_delta, round(100 * (x.m - b.m) / b.m, 6) + 0.0 AS m_pct, round(x.c - b.c, 6) + 0.0 AS c_delta, round(100 * (x.c - b.c) / b.c, 6) + 0.0 AS c_pct FROM x, b
""")
def relative_change(spark, sf_dir):
    return rounded(ag.against_baseline(settings(spark, sf_dir), "event_type", "view", ["m", "c"]).select("event_type", "m_delta", "m_pct", "c_delta", "c_pct"))


@query("""
WITH e AS (SELECT quantile_cont(l_extendedprice, 1 / 3.0) AS lo, quantile_cont(l_extendedprice, 2 / 3.0) AS hi FROM lineitem)
SELECT CASE WHEN l_extendedprice <= lo THEN 'slow' WHEN l_extendedprice <= hi THEN 'middle' ELSE 'fast' END AS speed, count(*) AS n, round(avg(l_quantity), 6) + 0.0 AS l_quantity FROM lineitem, e GROUP BY 1
""")
def qcut_terciles(spark, sf_dir):
    x = ag.terciles(items(spark, sf_dir), "l_extendedprice", "speed", ["slow", "middle", "fast"])
    return rounded(x.groupBy("speed").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("l_quantity")))


@query("""
SELECT l_suppkey, count(*) AS n, count(*) FILTER (v IS NULL) AS n_null, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, count(*) FILTER (v < 0) AS n_negative, coalesce(bool_and(v = 0), false) AS all_zero
FROM (SELECT l_suppkey, CASE WHEN l_tax > 0.01 THEN l_discount * 100 - 5 END AS v FROM lineitem) GROUP BY l_suppkey
""")
def field_quality(spark, sf_dir):
    x = items(spark, sf_dir).withColumn("v", F.when(F.col("l_tax") > 0.01, F.col("l_discount") * 100 - 5))
    return ag.field_quality(x, FIELD, "v")


@query("""
SELECT 'l_discount' AS "column", count(*) AS n, count(*) FILTER (l_discount IS NULL) AS n_null, count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) AS n_outside FROM lineitem
UNION ALL SELECT 'l_quantity', count(*), count(*) FILTER (l_quantity IS NULL), count(*) FILTER (l_quantity NOT BETWEEN 1 AND 40) FROM lineitem
""")
def range_guard(spark, sf_dir):
    return guards.ranges(items(spark, sf_dir), {"l_discount": (0, 0.05), "l_quantity": (1, 40)})


@query("""
SELECT 'positive quantity' AS rule, count(*) FILTER (NOT l_quantity > 0) AS n_failed, CASE WHEN count(*) FILTER (NOT l_quantity > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem
UNION ALL SELECT 'small discount', count(*) FILTER (NOT l_discount <= 0.05), CASE WHEN count(*) FILTER (NOT l_discount <= 0.05) = 0 THEN 'PASS' ELSE 'FAIL' END FROM lineitem
""")
def hard_rules(spark, sf_dir):
    return guards.rules(items(spark, sf_dir), {"positive quantity": F.col("l_quantity") > 0, "small discount": F.col("l_discount") <= 0.05})


@query("""
WITH a AS (SELECT user_id, sum(value) AS v, count(*)::DOUBLE AS c FROM events GROUP BY user_id), b AS (SELECT user_id, sum(value) + 1e-9 AS v, count(*)::DOUBLE AS c FROM events GROUP BY user_id)
SELECT 'v' AS "column", 0::BIGINT AS n_unmatched, 'close' AS status UNION ALL SELECT 'c', (SELECT count(*) FROM a ANTI JOIN b USING (user_id)), 'identical'
""")
def baseline_agreement(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.count("*").cast("double").alias("c"))
    b = a.withColumn("v", F.col("v") + 1e-9)
    return guards.agreement(a, b, ["user_id"], ["v", "c"]).drop("max_diff")


def cells_sql(v: str, extra: str = "") -> str:
    return f"SELECT user_id % 4 AS storm, date_diff('day', TIMESTAMP '2024-01-01', ts) AS d, hour(ts) AS h, {v} {extra} FROM events"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumns({"storm": F.col("user_id") % 4, "d": F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long"), "h": F.hour("ts").cast("long")})


@query(f"""
WITH x AS ({cells_sql("value AS v, event_id")}), y AS (SELECT *, row_number() OVER (PARTITION BY storm, h ORDER BY v DESC, event_id) AS n FROM x)
SELECT storm, h, round(sum(v * 0.5), 6) + 0.0 AS total, round(max(v), 6) + 0.0 AS peak, max(event_id) FILTER (n = 1) AS peak_time, coalesce(sum(0.5) FILTER (v >= 10), 0)::DOUBLE AS hours_10, coalesce(sum(0.5) FILTER (v >= 20), 0)::DOUBLE AS hours_20 FROM y GROUP BY storm, h
""")
def grid_accumulate(spark, sf_dir):
    return rounded(grid.accumulate(cells(spark, sf_dir), ["storm", "h"], "value", "event_id"))


FULL = """
WITH e AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS d, hour(ts) AS h, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY ALL),
g AS (SELECT d, h FROM range(30) a(d), range(24) b(h)), f AS (SELECT g.d, g.h, (coalesce(c, 0) >= 1)::INT::DOUBLE AS p, (coalesce(v, 0) >= 1)::INT::DOUBLE AS o FROM g LEFT JOIN e USING (d, h))
"""


def box(size: int) -> str:
    k = size // 2
    row = f"OVER (PARTITION BY d ORDER BY h RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    col = f"OVER (PARTITION BY h ORDER BY d RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    return f"SELECT {size} AS size, CASE WHEN sum(p * p + o * o) > 0 THEN 1 - sum((p - o) ** 2) / sum(p * p + o * o) END AS fss FROM (SELECT sum(p) {col} / {size * size} AS p, sum(o) {col} / {size * size} AS o FROM (SELECT d, h, sum(p) {row} AS p, sum(o) {row} AS o FROM f))"


@query(FULL + "SELECT 0::BIGINT AS storm, size::BIGINT AS size, round(fss, 6) + 0.0 AS fss FROM (" + " UNION ALL ".join(map(box, (3, 5, 9))) + ")")
def fss_box_filter(spark, sf_dir):
    e = cells(spark, sf_dir).groupBy("d", "h").agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "view").alias("v"))
    full = spark.range(30 * 24).select(F.floor(F.col("id") / 24).cast("long").alias("d"), (F.col("id") % 24).alias("h"))
    x = full.join(e, ["d", "h"], "left").withColumn("storm", F.lit(0).cast("long"))
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) >= 1
    return rounded(grid.fractions_skill(x, ["storm"], "d", "h", has("c"), has("v")))


PAIRS = [(a, b) for a in ("l_quantity", "l_extendedprice") for b in ("l_discount", "l_tax", "l_extendedprice") if a != b]


def rho_sql(a: str, b: str) -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {n}" for c, n in ((a, "p"), (b, "q")))
    return f"SELECT '{a}' AS x, '{b}' AS y, corr(p, q) AS rho, count(*) AS n FROM (SELECT {ranks} FROM (SELECT {a}, CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount, l_tax, l_extendedprice FROM lineitem) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)".replace("SELECT l_extendedprice, CASE", "SELECT l_quantity, CASE")


def correlations(spark, sf_dir):
    x = items(spark, sf_dir).withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount")))
    return stats.spearman(x, ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax", "l_extendedprice"])


@query("SELECT x, y, round(rho, 6) + 0.0 AS rho, n FROM (" + " UNION ALL ".join(rho_sql(a, b) for a, b in PAIRS) + ")")
def spearman_matrix(spark, sf_dir):
    return rounded(correlations(spark, sf_dir))


@query("SELECT x, y, round(rho, 6) + 0.0 AS rho, place FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY abs(rho) DESC, y) AS place FROM (" + " UNION ALL ".join(rho_sql(a, b) for a, b in PAIRS) + ")) WHERE place <= 2")
def spearman_top(spark, sf_dir):
    return rounded(stats.top_correlations(correlations(spark, sf_dir), ["x"], 2).select("x", "y", "rho", "place"))


@query("""
WITH x AS (SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) OVER () AS n FROM events)
SELECT event_id, round(r / n, 6) + 0.0 AS place FROM x
""")
def percent_rank(spark, sf_dir):
    return rounded(stats.percent_rank(table(spark, sf_dir, "events"), [], "value", "place").select("event_id", "place"))


@query("""
SELECT l_returnflag, count(*) AS n, round(1 - avg((l_extendedprice - 1400 * l_quantity) ** 2) / var_pop(l_extendedprice), 6) + 0.0 AS r2, round(avg(abs(l_extendedprice - 1400 * l_quantity)), 4) + 0.0 AS mae FROM lineitem GROUP BY l_returnflag
""")
def regression_scores(spark, sf_dir):
    x = stats.regression_scores(items(spark, sf_dir).withColumn("p", 1400 * F.col("l_quantity")), "l_extendedprice", "p", ["l_returnflag"])
    return rounded(x.select("l_returnflag", "n", "r2", F.round("mae", 4).alias("mae")))


TAIL = """
WITH f AS (SELECT l_returnflag AS k, l_orderkey, l_partkey, l_linenumber, l_quantity AS v FROM lineitem),
q AS (SELECT k, quantile_cont(v, 0.9) AS a0, quantile_cont(v, 0.95) AS a1, quantile_cont(v, 0.99) AS a2, max(v) AS a3 FROM f GROUP BY k),
t AS (SELECT *, least(greatest(60.0 / a1, 0.7), 3) AS f1, least(greatest(75.0 / a2, 0.7), 3) AS f2, least(greatest(100.0 / a3, 0.7), 5) AS f3 FROM q),
s AS (SELECT f.*, CASE WHEN v <= a0 THEN 1 WHEN v <= a1 THEN 1 + (f1 - 1) * coalesce((v - a0) / nullif(a1 - a0, 0), 1) WHEN v <= a2 THEN f1 + (f2 - f1) * coalesce((v - a1) / nullif(a2 - a1, 0), 1) ELSE f2 + (f3 - f2) * coalesce((v - a2) / nullif(a3 - a2, 0), 1) END AS m FROM f JOIN t USING (k))
"""


@query(TAIL + "SELECT k, l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, round(least(v * m, 90.0), 6) + 0.0 AS v FROM s")
def tail_scale_map(spark, sf_dir):
    x = items(spark, sf_dir).select(F.col("l_returnflag").alias("k"), "l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").alias("v"))
    t = x.select("k").distinct().select("k", F.lit(60.0).alias("p95"), F.lit(75.0).alias("p99"), F.lit(100.0).alias("top"), F.lit(90.0).alias("cap"))
    return rounded(calibration.scale_tail(x, t, "k", "v"))


@query("""
WITH f AS (SELECT l_suppkey AS k, l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity AS v FROM lineitem),
s AS (SELECT k, 100.0 * count(*) FILTER (v >= 25) AS have, count(*) AS n, 100.0 * count(*) * 0.4 AS want FROM f GROUP BY k),
t AS (SELECT k, want > have AS up, CASE WHEN abs(want - have) > 0.25 * want THEN least(round(abs(want - have) / 100.0), floor(0.05 * n)) ELSE 0 END AS m FROM s),
x AS (SELECT f.*, up, m, (m > 0) AND CASE WHEN up THEN v < 25 AND v > 0 ELSE v >= 25 END AS fits FROM f JOIN t USING (k)),
y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, abs(v - 25), l_orderkey, l_partkey, l_linenumber, l_extendedprice) AS i FROM x)
SELECT k, count(*) FILTER (fits AND i <= m) AS n_changed, round(sum(CASE WHEN fits AND i <= m THEN (CASE WHEN up THEN 25 ELSE 24.99 END) ELSE v END), 4) + 0.0 AS v FROM y GROUP BY k
""")
def area_calibration(spark, sf_dir):
    x = items(spark, sf_dir).select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.col("l_quantity").alias("v"))
    t = x.groupBy("k").agg((F.count("*") * 40.0).alias("want"))
    y = calibration.match_area(x, t, "k", "v", F.lit(100.0), "want", 25.0, tie=["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"])
    return y.groupBy("k").agg(F.count_if("changed").alias("n_changed"), (F.round(F.sum("v"), 4) + F.lit(0.0)).alias("v"))
