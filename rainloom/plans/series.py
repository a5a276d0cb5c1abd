"""Queries on series: storms are users, points are events, intensity is value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rainloom.functions import clean, geo
from rainloom.operators import joins, scenario, timeseries
from rainloom.plans.registry import query, rounded, table

BY, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("us", timeseries.micros(F.col("ts")))


@query("""
WITH x AS (SELECT event_id, user_id, value, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9 AS dt_h, value - lag(value) OVER w AS d
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, CASE WHEN dt_h > 0 THEN d / dt_h END AS rate FROM x)
SELECT event_id, user_id, round(dt_h, 6) + 0.0 AS dt_h,
  round(CASE WHEN row_number() OVER w = 1 THEN lead(rate) OVER w ELSE rate END, 6) + 0.0 AS value_rate
FROM y WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def motion_features(spark, sf_dir):
    x = timeseries.motion(table(spark, sf_dir, "events"), BY, ORDER, "ts", ["value"], edge="next")
    return rounded(x.select("event_id", "user_id", "dt_h", "value_rate"))


@query("""
SELECT event_id, round(sum(value) OVER w, 6) + 0.0 AS value_cumsum, round(max(value) OVER w, 6) + 0.0 AS value_cummax
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_cummax(spark, sf_dir):
    return rounded(timeseries.running(table(spark, sf_dir, "events"), BY, ORDER, "value").select("event_id", "value_cumsum", "value_cummax"))


@query("""
SELECT event_id, round(coalesce((row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0)::DOUBLE, 0), 6) + 0.0 AS life_progress
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def life_progress(spark, sf_dir):
    return rounded(timeseries.life_progress(table(spark, sf_dir, "events"), BY, ORDER).select("event_id", "life_progress"))


@query("""
WITH x AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events),
s AS (SELECT user_id, count(*) AS n_steps, quantile_cont(step, 0.95) AS p, max(step) AS m, greatest(2.5 * quantile_cont(step, 0.95), avg(step) + 4 * coalesce(stddev_samp(step), 0)) AS lim
      FROM x WHERE step IS NOT NULL GROUP BY user_id)
SELECT user_id, n_steps, round(p, 6) + 0.0 AS p95_step, round(m, 6) + 0.0 AS max_step, count(*) FILTER (x.step > lim) AS n_jumps
FROM x JOIN s USING (user_id) WHERE step IS NOT NULL GROUP BY user_id, n_steps, p, m
""")
def jump_detect(spark, sf_dir):
    return rounded(timeseries.jumps(table(spark, sf_dir, "events"), BY, ORDER, "value"))


@query("""
WITH x AS (SELECT event_id, user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 6 * 3600000000, false) AS gap FROM events)
SELECT event_id, CAST(sum(gap::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM x
""")
def gap_sessions(spark, sf_dir):
    x = events(spark, sf_dir)
    gap = F.col("us") - F.lag("us").over(timeseries.series(BY, ORDER)) > 6 * timeseries.HOUR_US
    return timeseries.sessions(x, BY, ORDER, gap).select("event_id", "session")


@query("""
WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 <> 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
y AS (SELECT *, CASE WHEN v IS NOT NULL THEN n END AS kn FROM x),
z AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS va, last_value(kn IGNORE NULLS) OVER a AS na, first_value(v IGNORE NULLS) OVER b AS vb, first_value(kn IGNORE NULLS) OVER b AS nb FROM y
      WINDOW a AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (vb - va) * (n - na) / (nb - na) END, 6) + 0.0 AS value FROM z
""")
def row_interp_fill(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return rounded(timeseries.fill_by_position(x, BY, ORDER, "value").select("event_id", "value"))


@query("""
WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 AND event_type <> 'error' THEN value END AS v FROM events),
g AS (SELECT event_type, quantile_cont(v, 0.5) AS m FROM x GROUP BY event_type)
SELECT event_id, round(coalesce(v, m, (SELECT quantile_cont(v, 0.5) FROM x), 0), 6) + 0.0 AS value FROM x JOIN g USING (event_type)
""")
def group_median_fill(spark, sf_dir):
    known = (F.col("event_id") % 7 != 0) & (F.col("event_type") != "error")
    x = table(spark, sf_dir, "events").withColumn("value", F.when(known, F.col("value")))
    return rounded(timeseries.fill_by_median(x, ["event_type"], ["value"]).select("event_id", "value"))


@query("""
WITH x AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, count(*) AS n, coalesce(bool_and(d > 0), true) AS is_monotone, coalesce(bool_and(d = 1800000000), true) AS on_cadence FROM x GROUP BY user_id
""")
def cadence_check(spark, sf_dir):
    return timeseries.cadence(table(spark, sf_dir, "events"), BY, ORDER, "ts", 30)


POS = "((event_id * 37) % 3600) / 10.0 - 180 AS lon, ((event_id * 13) % 1200) / 10.0 - 60 AS lat"


def placed(df):
    return df.withColumns({"lon": ((F.col("event_id") * 37) % 3600) / 10.0 - 180, "lat": ((F.col("event_id") * 13) % 1200) / 10.0 - 60})


def hav(a, b, c, d):
    """SQL of the great-circle distance."""
    dlon = f"(((({c} - {a} + 180) % 360) + 360) % 360 - 180)"
    q = f"(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({dlon}) / 2), 2))"
    return f"2 * 6371.0 * asin(CASE WHEN {q} > 1 THEN 1.0 ELSE sqrt({q}) END)"


@query(f"""
WITH x AS (SELECT event_id, user_id, ts, {POS} FROM events),
y AS (SELECT *, lag(lon) OVER w AS lon1, lag(lat) OVER w AS lat1 FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(sum(coalesce({hav("lon1", "lat1", "lon", "lat")}, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS path_km FROM y
""")
def path_length(spark, sf_dir):
    x = timeseries.path_length(placed(table(spark, sf_dir, "events")), BY, ORDER)
    return x.select("event_id", (F.round("path_km", 4) + F.lit(0.0)).alias("path_km"))


GRID = """
WITH x AS (SELECT user_id, epoch_us(ts) AS us, arg_max(value, event_id) AS value, arg_max(lon, event_id) AS lon FROM (SELECT *, %s FROM events) GROUP BY user_id, epoch_us(ts)),
y AS (SELECT *, lead(us) OVER w AS us1, lead(value) OVER w AS v1, lead(lon) OVER w AS lon1 FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, unnest(CASE WHEN us1 IS NULL THEN (CASE WHEN us %% 1800000000 = 0 THEN [us // 1800000000] ELSE [] END)
      ELSE range((us + 1799999999) // 1800000000, (us1 + 1799999999) // 1800000000) END) * 1800000000 AS gx FROM y),
h AS (SELECT *, coalesce((gx - us) / (us1 - us)::DOUBLE, 0) AS s FROM g)
"""


@query(GRID % POS + "SELECT user_id, gx AS us, round(CASE WHEN s = 0 THEN value ELSE value + (v1 - value) * s END, 6) + 0.0 AS value FROM h")
def halfhour_grid_interp(spark, sf_dir):
    return rounded(timeseries.interpolate(events(spark, sf_dir), BY, ["event_id"], "us", ["value"], 1_800_000_000))


W180 = "((((%s) + 180) %% 360 + 360) %% 360 - 180)"


@query(GRID % POS + f"SELECT user_id, gx AS us, round({W180 % ('lon + ' + W180 % 'lon1 - lon' + ' * s')}, 6) + 0.0 AS lon FROM h WHERE s > 0")
def lon_unwrap_interp(spark, sf_dir):
    x = timeseries.interpolate(placed(events(spark, sf_dir)), BY, ["event_id"], "us", [], 1_800_000_000, wrapped=["lon"])
    # grid points on a row are the row itself; the query shows those between rows
    own = placed(events(spark, sf_dir)).select("user_id", "us")
    return rounded(x.join(own, ["user_id", "us"], "left_anti"))


@query("""
WITH v AS (SELECT user_id, epoch_us(ts) AS us, min(event_id) AS e, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
c AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
x AS (SELECT c.event_id, v.value, abs(v.us - c.us) AS distance, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.us - c.us), v.us) AS n FROM c JOIN v USING (user_id))
SELECT c.event_id, round(x.value, 6) + 0.0 AS value, x.distance FROM c LEFT JOIN x ON c.event_id = x.event_id AND x.n = 1
""")
def nearest_time_join(spark, sf_dir):
    x = events(spark, sf_dir)
    views = x.where("event_type = 'view'").groupBy("user_id", "us").agg(F.min("value").alias("value"))
    clicks = x.where("event_type = 'click'").select("event_id", "user_id", "us")
    return rounded(joins.nearest_in_series(clicks, views, BY, "us", ["value"]).select("event_id", "value", "distance"))


@query("""
WITH t AS (SELECT event_id AS track_id, epoch_us(ts) AS tus, value AS tv FROM events WHERE event_type = 'view'),
f AS (SELECT event_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'click'),
x AS (SELECT event_id, track_id, abs(value - tv) AS cost, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - tv), tus, track_id) AS n FROM f JOIN t ON t.tus BETWEEN f.us - 10800000000 AND f.us + 10800000000)
SELECT f.event_id, round(cost, 6) + 0.0 AS cost, CASE WHEN cost <= 2.5 THEN track_id END AS track_id,
  CASE WHEN cost IS NULL THEN 'no_candidate' WHEN cost > 2.5 THEN 'too_far' ELSE 'matched' END AS status
FROM f LEFT JOIN x ON f.event_id = x.event_id AND n = 1
""")
def nearest_within_tolerance(spark, sf_dir):
    x = events(spark, sf_dir)
    frames = x.where("event_type = 'click'").select("event_id", "us", "value")
    track = x.where("event_type = 'view'").select(F.col("event_id").alias("track_id"), F.col("us").alias("tus"), F.col("value").alias("tv"))
    out = joins.nearest_value_within(frames, track, "us", "tus", 3 * timeseries.HOUR_US, "value", "tv", ["tus", "track_id"], 2.5, "event_id", ["track_id"])
    return rounded(out.select("event_id", "cost", "track_id", "status"))


@query("""
WITH t AS (SELECT user_id, epoch_us(ts) AS us, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL),
p AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
x AS (SELECT p.*, a.us AS ua, a.v AS va, b.us AS ub, b.v AS vb FROM p ASOF LEFT JOIN t a ON p.user_id = a.user_id AND p.us >= a.us ASOF LEFT JOIN t b ON p.user_id = b.user_id AND p.us <= b.us)
SELECT event_id, round(coalesce(va + (vb - va) * ((us - ua) / nullif(ub - ua, 0)::DOUBLE), va, vb), 6) + 0.0 AS value, ua IS NULL OR ub IS NULL AS outside FROM x
""")
def track_at_frames(spark, sf_dir):
    x = events(spark, sf_dir)
    track = x.where("event_type = 'view'").groupBy("user_id", "us").agg(F.min("value").alias("value"))
    frames = x.where("event_type = 'click'").select("event_id", "user_id", "us")
    return rounded(timeseries.at_times(frames, track, BY, "us", ["value"]).select("event_id", "value", "outside"))


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS size FROM events),
y AS (SELECT *, first_value(n) OVER (PARTITION BY user_id ORDER BY value DESC, n) AS peak FROM x),
z AS (SELECT event_id, CASE WHEN n = peak THEN 'peak' WHEN n = (peak + 1) // 2 THEN 'early' WHEN n = (peak + size + 1) // 2 THEN 'weakening' END AS snapshot FROM y)
SELECT event_id, snapshot FROM z WHERE snapshot IS NOT NULL
""")
def peak_snapshots(spark, sf_dir):
    return timeseries.snapshots(table(spark, sf_dir, "events"), BY, ORDER, "value").select("event_id", "snapshot")


@query(f"""
WITH x AS (SELECT event_id, user_id, ts, value, {POS} FROM events),
c AS (SELECT *, value * 10 - 500 AS coast, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS h FROM x),
d AS (SELECT *, h - first_value(h) OVER (PARTITION BY user_id ORDER BY abs(coast), h) AS dh FROM c)
SELECT event_id, round(least(value * 1.15, greatest(80.0, value)), 6) + 0.0 AS wind,
  round(greatest(1000 - value * 0.7 - 0.7 * (least(value * 1.15, greatest(80.0, value)) - value), least(870.0, 1000 - value * 0.7)), 6) + 0.0 AS pressure,
  round({W180 % 'lon - 100 / (111.32 * greatest(cos(radians(lat)), 1e-6))'}, 6) + 0.0 AS west_lon,
  round({W180 % 'lon - 75 * exp(-pow(dh / 24, 2) / 2) / (111.32 * greatest(cos(radians(lat)), 1e-6))'}, 6) + 0.0 AS near_lon
FROM d
""")
def scenario_shift(spark, sf_dir):
    x = placed(events(spark, sf_dir)).withColumns({"wind": F.col("value"), "pressure": 1000 - F.col("value") * 0.7, "coast": F.col("value") * 10 - 500})
    x = x.withColumn("h", (F.col("us") - F.min("us").over(Window.partitionBy(*BY))) / timeseries.HOUR_US)
    strong = scenario.intensify(x, "wind", "pressure", 1.15, 80.0, -0.7).select("event_id", "wind", "pressure")
    west = scenario.shift_west(x, 100.0).select("event_id", F.col("lon").alias("west_lon"))
    near = scenario.shift_near_shore(x, BY, "h", "coast").select("event_id", F.col("lon").alias("near_lon"))
    return rounded(strong.join(west, "event_id").join(near, "event_id"))


@query("""
WITH x AS (SELECT user_id, epoch_us(ts) AS us, arg_max(value, event_id) AS value FROM events GROUP BY ALL),
s AS (SELECT user_id, f + CAST(round((us - f) * 1.5) AS BIGINT) AS us, value FROM (SELECT *, min(us) OVER (PARTITION BY user_id) AS f FROM x)),
y AS (SELECT *, lead(us) OVER w AS us1, lead(value) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, unnest(CASE WHEN us1 IS NULL THEN [] ELSE range((us + 3599999999) // 3600000000, (us1 + 3599999999) // 3600000000) END) * 3600000000 AS gx FROM y)
SELECT user_id, gx AS us, round(value + (v1 - value) * ((gx - us) / (us1 - us)::DOUBLE), 6) + 0.0 AS value FROM g
""")
def time_stretch(spark, sf_dir):
    x = placed(events(spark, sf_dir))
    last = F.row_number().over(timeseries.series(["user_id", "us"], [F.col("event_id").desc()]))
    x = x.withColumn("k", last).where("k = 1")
    return rounded(scenario.stretch(x, BY, ["event_id"], "us", ["value"], 1.5, timeseries.HOUR_US).select("user_id", "us", "value"))


@query("""
SELECT event_id, round(exp(-abs(value * 10 - 500) / 200), 6) + 0.0 AS kernel, CAST(abs(value * 10 - 500) <= 100 AS BIGINT) AS is_near_coast, CAST(abs(value * 10 - 500) <= 300 AS BIGINT) AS is_near_coast_wide,
  CAST(value * 10 - 500 > 300 AS BIGINT) AS is_far_offshore, CAST(value * 10 - 500 < -100 AS BIGINT) AS is_inland FROM events
""")
def coast_kernel_flags(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("d", F.col("value") * 10 - 500)
    return rounded(x.select("event_id", geo.coast_kernel(F.col("d")).alias("kernel"), *[c.alias(k) for k, c in geo.coast_flags(F.col("d")).items()]))


@query("""
WITH x AS (SELECT event_id, CASE WHEN json_valid(props) THEN TRY_CAST(props ->> '$.k' AS DOUBLE) END AS k, value FROM events)
SELECT event_id, round(coalesce(k, value), 6) + 0.0 AS first_value, CASE WHEN abs(value) > 1e-12 THEN round(k / value, 6) + 0.0 END AS ratio,
  CASE WHEN k IS NULL THEN 'missing' WHEN k <= 30 THEN 'ok' WHEN k <= 60 THEN 'suspicious' ELSE 'abnormal' END AS status FROM x
""")
def status_ladder_ratio(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("k", clean.to_number(F.get_json_object("props", "$.k")))
    status = clean.ladder(F.col("k"), (30, "ok"), (60, "suspicious"), above="abnormal", missing="missing")
    return rounded(x.select("event_id", clean.first_present(F.col("k"), F.col("value")).alias("first_value"), clean.safe_ratio(F.col("k"), F.col("value")).alias("ratio"), status.alias("status")))
