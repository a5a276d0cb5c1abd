"""Queries on land and coasts, verification over time, key places, refits and comparisons of splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.operators import coast, grid, stats
from rainloom.plans.registry import query, rounded, table

RINGS = [(0, [(105.0, 5.0), (120.0, 4.0), (125.0, 18.0), (112.0, 25.0), (104.0, 15.0)]), (1, [(126.0, 10.0), (135.0, 12.0), (130.0, 22.0)])]
VERTICES = [(p, i, x, y) for p, ring in RINGS for i, (x, y) in enumerate(ring)]


@query("""
WITH v(poly, i, x, y) AS (VALUES """ + ", ".join(map(str, VERTICES)) + """), n AS (SELECT poly, max(i) AS last FROM v GROUP BY poly),
s AS (SELECT a.poly, a.x::DOUBLE AS x1, a.y::DOUBLE AS y1, b.x::DOUBLE AS x2, b.y::DOUBLE AS y2 FROM v a JOIN n USING (poly) JOIN v b ON b.poly = a.poly AND b.i = CASE WHEN a.i = n.last THEN 0 ELSE a.i + 1 END),
p AS (SELECT c_custkey, ((c_custkey * 73) % 400) / 10.0 + 100.03 AS x, ((c_custkey * 37) % 300) / 10.0 + 0.07 AS y FROM customer),
q AS (SELECT c_custkey, poly, ((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 AS hit, (x1 - x) * 111.32 * cos(radians(y)) AS ax, (y1 - y) * 111.32 AS ay, (x2 - x1) * 111.32 * cos(radians(y)) AS dx, (y2 - y1) * 111.32 AS dy FROM p, s),
d AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM q),
r AS (SELECT c_custkey, poly, sum(coalesce(hit, false)::INT) % 2 = 1 AS inside, min(sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)) AS km FROM d GROUP BY ALL)
SELECT c_custkey, bool_or(inside) AS on_land, CASE WHEN min(km) <= 300 THEN round(min(km), 6) + 0.0 END AS coast_km FROM r GROUP BY c_custkey
""")
def land_and_coast(spark, sf_dir):
    """Whether a place lies on land, and how far the coast is."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", (((k * 73) % 400) / 10.0 + 100.03).alias("lon"), (((k * 37) % 300) / 10.0 + 0.07).alias("lat"))
    s = coast.segments(spark.createDataFrame(VERTICES, "poly int, i int, x double, y double"))
    x = coast.coast_distance(coast.on_land(p, s, "c_custkey"), s, "c_custkey", 300.0)
    return rounded(x.select("c_custkey", "on_land", "coast_km"))


def cells_of(spark, sf_dir):
    """Two fields of 8 x 8 cells for every vector: its magnitudes, and those read backwards."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.abs(v.cast("double")) * 10).alias("f"))
    both = F.arrays_zip(F.col("f").alias("p"), F.reverse("f").alias("o"))
    x = e.select("vec_id", "label", F.posexplode(both).alias("i", "c"))
    return x.select("vec_id", "label", F.floor(F.col("i") / 8).cast("long").alias("irow"), (F.col("i") % 8).cast("long").alias("icol"), F.col("c.p").alias("p"), F.col("c.o").alias("o"))


CELLS = "WITH c AS (SELECT vec_id, label, i // 8 AS irow, i % 8 AS icol, abs(embedding[i + 1]::DOUBLE) * 10 AS p, abs(embedding[64 - i]::DOUBLE) * 10 AS o FROM embeddings, range(64) r(i)) "


@query(CELLS + """, t(threshold) AS (VALUES (0.5::DOUBLE), (1.0), (2.0)), s AS (SELECT label, threshold, sum(CASE WHEN p >= threshold THEN (irow + 1) * 50.0 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN o >= threshold THEN (irow + 1) * 50.0 ELSE 0 END)::DOUBLE AS b FROM c, t GROUP BY ALL)
SELECT label, round(threshold, 6) + 0.0 AS threshold, round(a, 6) + 0.0 AS predicted_km2h, round(b, 6) + 0.0 AS observed_km2h, round(a - b, 6) + 0.0 AS error_km2h, round(100 * (a - b) / nullif(b, 0), 6) + 0.0 AS error_pct FROM s""")
def duration_area_errors(spark, sf_dir):
    return rounded(grid.duration_area(cells_of(spark, sf_dir), ["label"], "p", "o", (F.col("irow") + 1) * 100.0, 0.5, (0.5, 1.0, 2.0)))


@query(CELLS + """, s AS (SELECT label, irow, icol, round(sum(p), 6) AS total, max(p) AS peak, count(*) FILTER (p >= 1)::DOUBLE AS wet FROM c GROUP BY ALL),
u AS (SELECT label, irow, icol, 'total' AS kind, total AS value FROM s UNION ALL SELECT label, irow, icol, 'peak', peak FROM s UNION ALL SELECT label, irow, icol, 'wet', wet FROM s)
SELECT label, kind, irow, icol, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY value DESC, irow, icol) AS n FROM u) WHERE n = 1""")
def key_locations(spark, sf_dir):
    s = cells_of(spark, sf_dir).groupBy("label", "irow", "icol").agg(F.round(F.sum("p"), 6).alias("total"), F.max("p").alias("peak"), F.count_if(F.col("p") >= 1).cast("double").alias("wet"))
    return rounded(grid.key_locations(s, ["label"], ["irow", "icol"], ["total", "peak", "wet"]))


@query("""
WITH b AS (SELECT event_type, event_id, value AS v, 2 * value + user_id % 5 AS z FROM events), f AS (SELECT event_type, regr_slope(z, v) AS k, regr_intercept(z, v) AS at0 FROM b GROUP BY event_type)
SELECT event_id, round(coalesce(at0 + k * v * 1.1, z), 6) + 0.0 AS z FROM b JOIN f USING (event_type)
""")
def refit_features(spark, sf_dir):
    """A derived feature follows a perturbed one along the line that the baseline's rows give."""
    b = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").alias("v"), (2 * F.col("value") + F.col("user_id") % 5).alias("z"))
    return rounded(stats.refit(b, b.withColumn("v", F.col("v") * 1.1), ["event_type"], "v", "z").select("event_id", "z"))


@query("""
WITH x AS (SELECT 'row' AS split, (l_orderkey + l_linenumber) % 4 = 0 AS test, l_quantity AS q, l_extendedprice::DOUBLE AS y FROM lineitem UNION ALL SELECT 'supplier', l_suppkey % 4 = 0, l_quantity, l_extendedprice::DOUBLE FROM lineitem),
m AS (SELECT split, q, avg(y) AS guess FROM x WHERE NOT test GROUP BY ALL), s AS (SELECT split, 1 - avg((y - guess) ** 2) / var_pop(y) AS r2, avg(abs(y - guess)) AS mae FROM x JOIN m USING (split, q) WHERE test GROUP BY split)
SELECT round(a.r2, 6) + 0.0 AS row_r2, round(a.mae, 6) + 0.0 AS row_mae, round(b.r2, 6) + 0.0 AS supplier_r2, round(b.mae, 6) + 0.0 AS supplier_mae, round(a.r2 - b.r2, 6) + 0.0 AS r2_drop, round(100 * (b.mae - a.mae) / a.mae, 6) + 0.0 AS mae_increase_pct
FROM s a, s b WHERE a.split = 'row' AND b.split = 'supplier'
""")
def split_comparison(spark, sf_dir):
    """What scores lose when whole groups are held out and not single rows."""
    x = table(spark, sf_dir, "lineitem")
    tests = F.array(F.struct(F.lit("row").alias("split"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4 == 0).alias("test")), F.struct(F.lit("supplier").alias("split"), (F.col("l_suppkey") % 4 == 0).alias("test")))
    x = x.select(F.explode(tests).alias("s"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").cast("double").alias("y")).select("s.*", "q", "y")
    guess = x.where("not test").groupBy("split", "q").agg(F.avg("y").alias("guess"))
    scores = stats.regression_scores(x.where("test").join(guess, ["split", "q"]), "y", "guess", ["split"])
    return rounded(stats.compare_splits(scores, [], "split", "row", "supplier"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT event_id % 97) AS n_kinds FROM events GROUP BY event_type")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.col("event_id") % 97).alias("n_kinds"))
