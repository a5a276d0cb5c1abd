"""Queries on refreshed features, filled gaps, repeated validation and one-pass components."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.operators import coast, eof, grouped, imputation, joins, refresh, scenario, timeseries
from rainloom.plans.registry import query, rounded, table
from rainloom.plans.series import hav
from rainloom.plans.validation import VERTICES

BY, ORDER = ["user_id"], ["ts", "event_id"]
TRACK = """
WITH b AS (SELECT event_id, user_id, ts, ((event_id * 37) % 400) / 10.0::DOUBLE + 100.03 AS lon, ((event_id * 13) % 300) / 10.0::DOUBLE + 0.07 AS lat, (20 + (event_id * 7) % 50)::DOUBLE AS wind, (1010 - (20 + (event_id * 7) % 50) * 1.2 + event_id % 3)::DOUBLE AS pressure FROM events),
s AS (SELECT avg(wind) AS wm, stddev_samp(wind) AS ws, avg(1010 - pressure) AS dm, stddev_samp(1010 - pressure) AS ds FROM b),
t AS (SELECT event_id, user_id, ts, (lon - 100 / (111.32 * greatest(cos(radians(lat)), 1e-6)) + 180) % 360 - 180 AS lon, lat, wind * 1.1 AS wind, pressure FROM b),
"""


def track(spark, sf_dir):
    e = F.col("event_id")
    wind = (20 + (e * 7) % 50).cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("ts").alias("time"), (((e * 37) % 400) / 10.0 + 100.03).alias("lon"), (((e * 13) % 300) / 10.0 + 0.07).alias("lat"), wind.alias("wind"), (1010 - wind * 1.2 + e % 3).alias("pressure"))


@query(TRACK + "v(poly, i, x, y) AS (VALUES " + ", ".join(map(str, VERTICES)) + """), n AS (SELECT poly, max(i) AS last FROM v GROUP BY poly),
c AS (SELECT a.poly, a.x::DOUBLE AS x1, a.y::DOUBLE AS y1, b.x::DOUBLE AS x2, b.y::DOUBLE AS y2 FROM v a JOIN n USING (poly) JOIN v b ON b.poly = a.poly AND b.i = CASE WHEN a.i = n.last THEN 0 ELSE a.i + 1 END),
q AS (SELECT event_id, poly, ((y1 > lat) <> (y2 > lat)) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 AS hit, (x1 - lon) * 111.32 * cos(radians(lat)) AS ax, (y1 - lat) * 111.32 AS ay, (x2 - x1) * 111.32 * cos(radians(lat)) AS dx, (y2 - y1) * 111.32 AS dy FROM t, c),
d AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS u FROM q),
r AS (SELECT event_id, poly, sum(coalesce(hit, false)::INT) % 2 = 1 AS inside, min(sqrt((ax + u * dx) ** 2 + (ay + u * dy) ** 2)) AS km FROM d GROUP BY ALL),
g AS (SELECT event_id, bool_or(inside) AS on_land, CASE WHEN min(km) <= 300 THEN min(km) END AS coast_km FROM r GROUP BY event_id),
m AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9 AS h, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, wind - lag(wind) OVER w AS dw, pressure - lag(pressure) OVER w AS dp FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, CASE WHEN h > 0 THEN """ + hav("lon0", "lat0", "lon", "lat") + """ END AS km, CASE WHEN h > 0 THEN (degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) + 360) % 360 END AS dir, CASE WHEN h > 0 THEN dw / h END AS wr, CASE WHEN h > 0 THEN dp / h END AS pr, row_number() OVER w = 1 AS f FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT event_id, ts, user_id, wind, pressure, CASE WHEN f THEN lead(h) OVER w ELSE h END AS dt_h, CASE WHEN f THEN lead(km / h) OVER w ELSE km / h END AS speed, CASE WHEN f THEN lead(dir) OVER w ELSE dir END AS dir, CASE WHEN f THEN lead(wr) OVER w ELSE wr END AS wr, CASE WHEN f THEN lead(pr) OVER w ELSE pr END AS pr FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(dt_h, 6) + 0.0 AS dt_h, round(speed, 3) + 0.0 AS move_speed, round(sin(radians(dir)), 6) + 0.0 AS move_sin, round(cos(radians(dir)), 6) + 0.0 AS move_cos, round(wr, 4) + 0.0 AS wind_rate, coalesce(wr > 0 AND pr <= 0, false) AS intensifying, coalesce(wr < 0 AND pr >= 0, false) AS weakening, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin,
  on_land, round(coast_km, 6) + 0.0 AS coast_km, round(coalesce(exp(-coast_km / 300), 0), 6) + 0.0 AS coast_near, round(0.5 * (wind - wm) / ws + 0.5 * (1010 - pressure - dm) / ds, 6) + 0.0 AS intensity_index,
  round(coalesce((row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0)::DOUBLE, 0), 6) + 0.0 AS life_progress
FROM e JOIN g USING (event_id), s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def feature_refresh(spark, sf_dir):
    """A track shifted west with stronger wind: all that depends on either is made again, what doesn't keeps its values."""
    base = track(spark, sf_dir)
    shore = coast.segments(spark.createDataFrame(VERTICES, "poly int, i int, x double, y double"))
    rules = refresh.track_features(BY, ORDER, shore, 300.0, refresh.baseline_scale(base))
    described = rules.refresh(base, base.columns)
    moved = scenario.shift_west(described, 100.0).withColumn("wind", F.col("wind") * 1.1)
    x = rules.refresh(moved, ["lon", "wind"])
    return rounded(x.select("event_id", "dt_h", F.round("move_speed", 3).alias("move_speed"), "move_sin", "move_cos", F.round("wind_rate", 4).alias("wind_rate"), "intensifying", "weakening", "hour_sin", "on_land", "coast_km", "coast_near", "intensity_index", "life_progress"))


CHAINS = {"a": [imputation.INTERPOLATED, imputation.GROUP_MEDIAN, imputation.HISTORY_MEDIAN], "b": [imputation.MODE, imputation.HISTORY_MEDIAN], "c": [imputation.GROUP_MEDIAN, imputation.HISTORY_MEDIAN], "d": [imputation.HISTORY_MEDIAN]}


@query("""
WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 3 > 0 AND user_id % 5 > 0 THEN value END AS a, CASE WHEN event_id % 4 > 0 THEN (event_id * 7 % 6)::DOUBLE END AS b, CASE WHEN event_id % 2 > 0 AND user_id % 3 > 0 THEN value END AS c FROM events),
h AS (SELECT quantile_cont(value, 0.5) AS m FROM events WHERE event_id % 2 = 0), mode AS (SELECT b AS v FROM x WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1),
i AS (SELECT *, last_value(CASE WHEN a IS NOT NULL THEN n END IGNORE NULLS) OVER p AS n0, last_value(a IGNORE NULLS) OVER p AS a0, first_value(CASE WHEN a IS NOT NULL THEN n END IGNORE NULLS) OVER q AS n1, first_value(a IGNORE NULLS) OVER q AS a1 FROM x
  WINDOW p AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, CASE WHEN a0 IS NULL THEN a1 WHEN a1 IS NULL THEN a0 ELSE a0 + (a1 - a0) * coalesce((n - n0) / nullif(n1 - n0, 0)::DOUBLE, 0) END AS ai FROM i),
g AS (SELECT user_id, quantile_cont(coalesce(a, ai), 0.5) AS ga, quantile_cont(c, 0.5) AS gc FROM f GROUP BY user_id)
SELECT event_id, round(coalesce(a, ai, ga, m), 6) + 0.0 AS a, CASE WHEN a IS NOT NULL THEN 'own' WHEN ai IS NOT NULL THEN 'interpolated' WHEN ga IS NOT NULL THEN 'group_median' ELSE 'history_median' END AS a_source,
  round(coalesce(b, v), 6) + 0.0 AS b, CASE WHEN b IS NOT NULL THEN 'own' ELSE 'mode' END AS b_source, round(coalesce(c, gc, m), 6) + 0.0 AS c, CASE WHEN c IS NOT NULL THEN 'own' WHEN gc IS NOT NULL THEN 'group_median' ELSE 'history_median' END AS c_source, 0.0::DOUBLE AS d, 'zero' AS d_source
FROM f JOIN g USING (user_id), h, mode
""")
def imputation_chain(spark, sf_dir):
    """Gaps filled between neighbours, by medians, by the most frequent value and at last by 0, with the source of every value."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    history = e.where("event_id % 2 = 0").select(v.alias("a"), v.alias("b"), v.alias("c"), F.lit(None).cast("double").alias("d"))
    x = e.select("event_id", "user_id", "ts", F.when((F.col("event_id") % 3 > 0) & (F.col("user_id") % 5 > 0), v).alias("a"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") * 7 % 6).cast("double")).alias("b"), F.when((F.col("event_id") % 2 > 0) & (F.col("user_id") % 3 > 0), v).alias("c"), F.lit(None).cast("double").alias("d"))
    return rounded(imputation.impute(x, history, BY, ORDER, CHAINS).drop("user_id", "ts"), "event_id")


@query("""
WITH x AS (SELECT repeat, l_suppkey AS k, l_quantity AS q, l_extendedprice::DOUBLE AS y, ln(1 + l_extendedprice::DOUBLE) AS z, ((l_suppkey * 7919 + repeat * 104729) % 1000) / 1000.0 < 0.25 AS test FROM lineitem, range(1, 21) r(repeat)),
f AS (SELECT repeat, regr_slope(z, q) AS b, regr_intercept(z, q) AS a, avg(y) AS m FROM x WHERE NOT test GROUP BY repeat), p AS (SELECT x.*, a + b * q AS g, exp(a + b * q) - 1 AS p, m FROM x JOIN f USING (repeat)),
s AS (SELECT repeat, count(*) FILTER (NOT test) AS n_train, count(*) FILTER (test) AS n_test, count(DISTINCT k) FILTER (NOT test) AS n_train_groups, count(DISTINCT k) FILTER (test) AS n_test_groups, 1 - avg((y - p) ** 2) FILTER (NOT test) / var_pop(y) FILTER (NOT test) AS train_r2, 1 - avg((y - p) ** 2) FILTER (test) / var_pop(y) FILTER (test) AS test_r2,
  1 - avg((z - g) ** 2) FILTER (test) / var_pop(z) FILTER (test) AS test_r2_model, avg(abs(y - p)) FILTER (test) AS test_mae, sqrt(avg((y - p) ** 2) FILTER (test)) AS test_rmse, avg(abs(y - m)) FILTER (test) AS baseline_mae, sqrt(avg((y - m) ** 2) FILTER (test)) AS baseline_rmse FROM p GROUP BY repeat)
SELECT count(*) AS n_repeats, """ + ", ".join(f"round({f}({c}), 4) + 0.0 AS {c}_{n}" for c in ("n_train", "n_test", "n_train_groups", "n_test_groups", "train_r2", "test_r2", "test_r2_model", "test_mae", "test_rmse", "baseline_mae", "baseline_rmse") for f, n in (("avg", "mean"), ("stddev_samp", "std"))) + """,
  round(100 * (avg(baseline_mae) - avg(test_mae)) / avg(baseline_mae), 4) + 0.0 AS mae_gain_pct, round(100 * (avg(baseline_rmse) - avg(test_rmse)) / avg(baseline_rmse), 4) + 0.0 AS rmse_gain_pct FROM s
""")
def repeated_validation(spark, sf_dir):
    """Twenty splits of suppliers, a model of the logarithm in each, and the mean and deviation of its scores beside those of the mean."""
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    draw = ((F.col("l_suppkey") * 7919 + F.col("repeat") * 104729) % 1000) / 1000.0
    scores = grouped.validate(x, "l_suppkey", ["l_quantity"], "l_extendedprice", grouped.line_by_repeat, 20, 0.25, log=True, draw=draw)
    s = grouped.summarise(scores)
    return s.select("n_repeats", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in s.columns if c != "n_repeats"])


@query()
def one_pass_components(spark, sf_dir):
    """Components of the embeddings' magnitudes from a single pass, and each field's reconstruction by them."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("field"))
    return eof.reconstruct(x, "field", "vec_id", eof.fit_once(x, "field", rank=10)).select("vec_id", "rmse", "corr", "energy_ratio")


@query("""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, ((event_id * 37) % 3600) / 10.0::DOUBLE - 180 AS lon, ((event_id * 13) % 1600) / 10.0::DOUBLE - 80 AS lat FROM events),
t AS (SELECT event_id AS track_id, us AS tus, lon AS lon2, lat AS lat2 FROM e WHERE event_type = 'view'), f AS (SELECT * FROM e WHERE event_type = 'click'),
x AS (SELECT event_id, track_id, tus, """ + hav("lon", "lat", "lon2", "lat2") + """ AS km FROM f JOIN t ON tus BETWEEN us - 43200000000 AND us + 43200000000),
n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, tus, track_id) = 1)
SELECT f.event_id, round(km, 4) + 0.0 AS cost, CASE WHEN km <= 600 THEN track_id END AS track_id, CASE WHEN km IS NULL THEN 'no_candidate' WHEN km > 600 THEN 'too_far' ELSE 'matched' END AS status FROM f LEFT JOIN n USING (event_id)
""")
def nearest_space_time(spark, sf_dir):
    """Clicks with the nearest view of the twelve hours before and behind, within 600 km."""
    e = F.col("event_id")
    x = table(spark, sf_dir, "events").withColumns({"us": timeseries.micros(F.col("ts")), "lon": ((e * 37) % 3600) / 10.0 - 180, "lat": ((e * 13) % 1600) / 10.0 - 80})
    frames = x.where("event_type = 'click'").select("event_id", "us", "lon", "lat")
    views = x.where("event_type = 'view'").select(e.alias("track_id"), F.col("us").alias("tus"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    out = joins.nearest_in_space(frames, views, "us", "tus", 12 * timeseries.HOUR_US, ("lon", "lat"), ("lon2", "lat2"), 600.0, "event_id", ["track_id"], ["tus", "track_id"])
    return out.select("event_id", (F.round("cost", 4) + F.lit(0.0)).alias("cost"), "track_id", "status")
