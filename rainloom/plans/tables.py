"""Queries on tables: joins, filters, names, sets, retrieval and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rainloom.functions import clean, columns, geo
from rainloom.operators import calibration, eof, grid, guards, joins, retrieval, scenario, stats
from rainloom.plans.registry import query, rounded, table
from rainloom.plans.series import hav


@query("""
WITH c AS (SELECT c_custkey, ((c_custkey * 73) % 3600) / 10.0 - 180 AS lon, ((c_custkey * 37) % 1600) / 10.0 - 80 AS lat, ((c_nationkey * 47) % 360) - 180.0 AS lon2, ((c_nationkey * 13) % 160) - 80.0 AS lat2 FROM customer)
SELECT c_custkey, round(""" + hav("lon", "lat", "lon2", "lat2") + """, 4) + 0.0 AS km,
  round(((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360), 4) + 0.0 AS bearing,
  round((((lon * 3 + 180) % 360 + 360) % 360) - 180, 6) + 0.0 AS wrapped FROM c
""")
def haversine_bearing(spark, sf_dir):
    x = table(spark, sf_dir, "customer")
    a = ((F.col("c_custkey") * 73) % 3600) / 10.0 - 180, ((F.col("c_custkey") * 37) % 1600) / 10.0 - 80
    b = ((F.col("c_nationkey") * 47) % 360) - 180.0, ((F.col("c_nationkey") * 13) % 160) - 80.0
    return rounded(x.select("c_custkey", F.round(geo.haversine_km(*a, *b), 4).alias("km"), F.round(geo.bearing_deg(*a, *b), 4).alias("bearing"), geo.wrap180(a[0] * 3).alias("wrapped")))


@query("""
SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos,
  CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' WHEN month(o_orderdate) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season FROM orders
""")
def cyclic_time_season(spark, sf_dir):
    s, c = geo.cyclic(F.month("o_orderdate"), 12)
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", s.alias("month_sin"), c.alias("month_cos"), geo.season(F.month("o_orderdate")).alias("season")))


@query("""
SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS plain, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') || '_' || lpad(p_partkey::VARCHAR, 7, '0') AS uid FROM part
""")
def name_normalise_uid(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", clean.plain_name(F.col("p_name")).alias("plain"), clean.uid(clean.plain_name(F.col("p_brand")), F.col("p_partkey"), width=7).alias("uid"))


@query("""
SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, c_acctbal), 6) + 0.0 AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def fill_missing_join(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"))
    return rounded(joins.fill_from(x, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("price")), ["k"], ["price"]).select("o_orderkey", "price"))


@query("""
SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def metadata_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k")).join(c, "k", "left")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return x.join(n, "c_nationkey", "left").select("o_orderkey", F.coalesce("segment", F.lit("none")).alias("segment"), "n_name")


@query("""
SELECT 'kept' AS what, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
UNION ALL SELECT 'left', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def semi_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(o.join(r, "o_orderkey", "left_semi"), "kept").unionByName(count(o.join(r, "o_orderkey", "left_anti"), "left"))


@query("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' ELSE 'only_right' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
""")
def key_differences(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return joins.differences(a, table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) + 0.0 AS price FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.06 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'")
def bbox_filter(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 20) & F.col("l_discount").between(0.02, 0.06) & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return x.agg(F.count("*").alias("n"), (F.round(F.sum("l_extendedprice"), 2) + F.lit(0.0)).alias("price"))


@query("""
SELECT o_orderkey FROM orders WHERE NOT (coalesce(o_custkey % 97 = 3, false) OR coalesce(o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1996-09-01', false))
""")
def target_exclusion(spark, sf_dir):
    t = F.col("o_orderdate")
    name = F.coalesce(F.col("o_custkey") % 97 == 3, F.lit(False))
    time = F.coalesce((t >= F.lit("1996-06-01").cast("timestamp_ntz")) & (t < F.lit("1996-09-01").cast("timestamp_ntz")), F.lit(False))
    return table(spark, sf_dir, "orders").where(~(name | time)).select("o_orderkey")


@query("""
WITH c AS (SELECT count(*) FILTER (event_type = 'error' AND value > 1e6) AS a, count(*) FILTER (event_type = 'error') AS b FROM events),
f AS (SELECT e.value, CASE WHEN a >= 30 THEN 0 WHEN b >= 30 THEN 1 ELSE 2 END AS level FROM events e, c WHERE CASE WHEN a >= 30 THEN event_type = 'error' AND value > 1e6 WHEN b >= 30 THEN event_type = 'error' ELSE true END)
SELECT max(level)::BIGINT AS level, count(*) AS n, round(quantile_cont(value, 0.1), 6) + 0.0 AS value_p10, round(quantile_cont(value, 0.5), 6) + 0.0 AS value_p50, round(quantile_cont(value, 0.9), 6) + 0.0 AS value_p90 FROM f
""")
def cascade_filter(spark, sf_dir):
    error = F.col("event_type") == "error"
    return rounded(scenario.envelope(table(spark, sf_dir, "events"), error & (F.col("value") > 1e6), [error], ["value"]))


@query("""
SELECT l_returnflag, name, round(sum(v), 2) + 0.0 AS total FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME name VALUE v) GROUP BY ALL
""")
def melt_unpivot(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax").unpivot("l_returnflag", ["l_quantity", "l_discount", "l_tax"], "name", "v")
    return x.groupBy("l_returnflag", "name").agg((F.round(F.sum("v"), 2) + F.lit(0.0)).alias("total"))


@query("""
SELECT k, max(src) AS src FROM (SELECT o_custkey AS k, 'orders' AS src FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer) GROUP BY k
""")
def union_distinct(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("src"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("src"))).groupBy("k").agg(F.max("src").alias("src"))


@query("""
SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def drop_duplicates_last(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, round(value, 6) + 0.0 AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def group_top_n(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    return rounded(table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id", "value", "n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(10)


@query("SELECT user_id, user_id % 4 = 0 AS is_test, count(*) AS n FROM events GROUP BY user_id")
def group_split_assign(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("is_test", F.col("user_id") % 4 == 0).groupBy("user_id", "is_test").agg(F.count("*").alias("n"))


@query()
def group_shuffle_split(spark, sf_dir):
    x = stats.group_split(table(spark, sf_dir, "events"), "user_id", 0.25, seed=3)
    return x.groupBy("user_id", "is_test").agg(F.count("*").alias("n"))


@query("""
WITH p(place, plon, plat) AS (VALUES (0, 120.0, 20.0), (1, -75.0, 25.0)), x AS (SELECT user_id, event_id, ((event_id * 37) % 3600) / 10.0 - 180 AS lon, ((event_id * 13) % 1200) / 10.0 - 60 AS lat FROM events),
y AS (SELECT user_id, place::BIGINT AS place, event_id, """ + hav("lon", "lat", "plon", "plat") + """ AS km FROM x, p), z AS (SELECT *, row_number() OVER (PARTITION BY user_id, place ORDER BY km, event_id) AS n FROM y)
SELECT user_id, place, event_id, round(km, 4) + 0.0 AS cost FROM z WHERE n = 1
""")
def nearest_track_point(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("user_id", "event_id", (((F.col("event_id") * 37) % 3600) / 10.0 - 180).alias("lon"), (((F.col("event_id") * 13) % 1200) / 10.0 - 60).alias("lat"))
    two = F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.lit(a).alias("plon"), F.lit(b).alias("plat")) for i, a, b in ((0, 120.0, 20.0), (1, -75.0, 25.0))])
    places = x.select("user_id").distinct().withColumn("p", F.explode(two)).select("user_id", "p.*")
    cost = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    return joins.nearest_to_place(x, places, ["user_id"], cost, ["event_id"], ["event_id"]).select("user_id", "place", "event_id", (F.round("cost", 4) + F.lit(0.0)).alias("cost"))


@query("""
WITH p AS (SELECT c_custkey, ((c_custkey * 73) % 400) / 10.0 + 100 AS lon, ((c_custkey * 37) % 300) / 10.0 AS lat FROM customer),
o AS (SELECT i * 50.0 AS e, j * 50.0 AS k FROM range(-4, 5) a(i), range(-4, 5) b(j) WHERE (i * i + j * j) * 2500.0 <= 40000.0),
s AS (SELECT c_custkey, floor((round(lat, 2) + k / 111.32) / 0.5) AS r, floor((round(lon, 2) + e / (111.32 * greatest(cos(radians(round(lat, 2))), 1e-6))) / 0.5) AS c FROM p, o)
SELECT c_custkey, round(avg(((r * 7 + c) % 3 = 0)::INT), 6) + 0.0 AS land_share, count(*) AS n_sampled FROM s GROUP BY c_custkey
""")
def circle_neighbourhood(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_custkey", (((F.col("c_custkey") * 73) % 400) / 10.0 + 100).alias("lon"), (((F.col("c_custkey") * 37) % 300) / 10.0).alias("lat"))
    cells = spark.range(100 * 140).select((F.floor(F.col("id") / 140) - 20).alias("irow"), ((F.col("id") % 140) + 170).alias("icol")).withColumn("land", (F.col("irow") * 7 + F.col("icol")) % 3 == 0)
    return rounded(joins.neighbourhood(p, cells, 200.0, 50.0, 0.5, "land").select("c_custkey", "land_share", "n_sampled"))


@query("""
WITH a AS (SELECT c_custkey, round(((c_custkey * 73) % 3600) / 10.0, 6) AS lon FROM customer), b AS (SELECT i AS ix, round(i * 0.1, 6) AS lon FROM range(3600) r(i))
SELECT c_custkey, ix FROM a JOIN b USING (lon)
""")
def grid_embedding(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", F.round(((F.col("c_custkey") * 73) % 3600) / 10.0, 6).alias("lon"))
    return a.join(spark.range(3600).select(F.col("id").alias("ix"), F.round(F.col("id") * 0.1, 6).alias("lon")), "lon").select("c_custkey", "ix")


DIST = "list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 FOR i IN range(1, 65)])"


@query(f"""
WITH x AS (SELECT a.vec_id AS target_id, b.vec_id AS history_id, sqrt({DIST}) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT target_id, history_id, rank, round(d, 6) + 0.0 AS distance, round(1 / (1 + d / 8), 6) + 0.0 AS similarity FROM x WHERE rank <= 10
""")
def topk_analogs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = retrieval.neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", 10, exclude="self", root=True)
    w = Window.partitionBy("target_id").orderBy("distance", "history_id")
    return rounded(x.select("target_id", "history_id", F.row_number().over(w).alias("rank"), "distance", retrieval.similarity(F.col("distance"), 64).alias("similarity")))


COMPONENTS = {"track": (slice(0, 16), 1.0), "intensity": (slice(16, 32), 1.5), "motion": (slice(32, 64), 1.2)}
WEIGHTED = " + ".join(f"{w} * list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 FOR i IN range({s.start + 1}, {s.stop + 1})]) / {s.stop - s.start}" for s, w in COMPONENTS.values())
EDGES = f"""
WITH d AS (SELECT a.vec_id AS target_id, a.label AS tl, b.vec_id AS history_id, b.label AS g, {WEIGHTED} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, history_id) AS n FROM d) WHERE n <= 100),
c AS (SELECT *, (row_number() OVER (PARTITION BY target_id, g ORDER BY d, history_id) > 3)::INT AS over FROM p),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY over, d, history_id) AS r FROM c) WHERE r <= 20),
w AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, history_id) AS rank, exp(-(d - min(d) OVER (PARTITION BY target_id)) / quantile_cont(d, 0.5) OVER (PARTITION BY target_id)) AS e FROM k),
s AS (SELECT *, e / sum(e) OVER (PARTITION BY target_id) AS weight FROM w)
"""


def edges(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pool = retrieval.neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", 100, slices=COMPONENTS, group="label", exclude="self")
    return retrieval.softmax_weights(retrieval.diversified(pool, 20, 3))


@query(EDGES + "SELECT target_id, history_id, rank, round(d, 6) + 0.0 AS distance, round(weight, 6) + 0.0 AS similarity_weight FROM s")
def topk_diversified_softmax(spark, sf_dir):
    return rounded(edges(spark, sf_dir).select("target_id", "history_id", "rank", "distance", "similarity_weight"))


@query(f"""
WITH x AS (SELECT a.vec_id AS target_id, b.vec_id AS history_id, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 50 = 0)
SELECT target_id, history_id, round(d, 6) + 0.0 AS distance FROM x WHERE n <= 5
""")
def leave_group_out_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = retrieval.neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", 5, group="label", exclude="group")
    return rounded(x.select("target_id", "history_id", "distance"))


@query(EDGES + """, v AS (SELECT target_id, weight, (history_id % 101)::DOUBLE AS v FROM s), q AS (SELECT target_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM v GROUP BY target_id)
SELECT target_id, round(sum(weight * least(greatest(v, lo), hi)) / sum(weight), 6) + 0.0 AS v FROM v JOIN q USING (target_id) GROUP BY target_id""")
def winsor_targets(spark, sf_dir):
    x = edges(spark, sf_dir).withColumn("v", (F.col("history_id") % 101).cast("double"))
    return rounded(calibration.winsorised_means(x, ["v"]))


@query(EDGES + "SELECT history_id, count(*) AS n, min(rank) AS best_rank, round(avg(rank), 6) + 0.0 AS mean_rank, round(max(weight), 6) + 0.0 AS max_weight, round(avg(weight), 6) + 0.0 AS mean_weight, round(sum(weight), 6) + 0.0 AS sum_weight FROM s GROUP BY history_id")
def edge_summary(spark, sf_dir):
    return rounded(retrieval.edge_summary(edges(spark, sf_dir)))


@query(EDGES + """, f AS (SELECT vec_id AS history_id, i // 8 AS iy, i % 8 AS ix, abs(embedding[i + 1]::DOUBLE) AS rain FROM embeddings, range(64) r(i))
SELECT target_id, iy, ix, round(exp(sum(weight * ln(1 + rain)) / sum(weight)) - 1, 6) + 0.0 AS rain, count(*) AS n_templates FROM s JOIN f USING (history_id) GROUP BY ALL""")
def weighted_log_fusion(spark, sf_dir):
    f = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("history_id"), F.posexplode("embedding").alias("i", "v"))
    f = f.select("history_id", F.floor(F.col("i") / 8).cast("long").alias("iy"), (F.col("i") % 8).cast("long").alias("ix"), F.abs(F.col("v").cast("double")).alias("rain"))
    return rounded(grid.fuse(edges(spark, sf_dir), f, "rain"))


@query("""
WITH c AS (SELECT vec_id AS k, i // 8 AS r, i % 8 AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)),
p AS (SELECT vec_id AS k, j AS p, ((vec_id * 7 + j * 3) % 70) / 10.0 AS y, ((vec_id * 3 + j * 11) % 70) / 10.0 AS x FROM embeddings, range(5) t(j)),
q AS (SELECT p.*, floor(y) AS r0, floor(x) AS c0 FROM p),
s AS (SELECT q.k, q.p, sum(c.v * (1 - abs(y - c.r)) * (1 - abs(x - c.c))) AS v FROM q JOIN c ON c.k = q.k AND c.r BETWEEN r0 AND r0 + 1 AND c.c BETWEEN c0 AND c0 + 1 GROUP BY ALL)
SELECT k, p, round(v, 6) + 0.0 AS v FROM s
""")
def bilinear_resample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = e.select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("i", "v")).select("k", F.floor(F.col("i") / 8).cast("long").alias("irow"), (F.col("i") % 8).cast("long").alias("icol"), F.col("v").cast("double").alias("v"))
    p = e.select(F.col("vec_id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("p"))
    p = p.withColumns({"y": ((F.col("k") * 7 + F.col("p") * 3) % 70) / 10.0, "x": ((F.col("k") * 3 + F.col("p") * 11) % 70) / 10.0, "__id": F.struct("k", "p")})
    return rounded(grid.bilinear(p, c, ["k"], "y", "x", "v").select("k", "p", "v"))


@query()
def pca_blend(spark, sf_dir):
    """Components of the embeddings' magnitudes as fields, and each field blended with its reconstruction."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("field"))
    basis = eof.fit(x, "field", rank=10)
    return eof.reconstruct(x, "field", "vec_id", basis).select("vec_id", "rmse", "corr", "energy_ratio", F.aggregate("field", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query()
def forest_importance(spark, sf_dir):
    """A forest on line items, scored on groups it hasn't seen, and what permuting each feature costs."""
    x = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("__row"), "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    x = stats.group_split(x, "l_suppkey")
    features = ["l_quantity", "l_discount", "l_tax"]
    predict = stats.forest(x.where("not is_test"), features, "l_extendedprice", trees=200, depth=12)
    return stats.permutation_importance(x.where("is_test"), features, "l_extendedprice", predict, repeats=10)


@query("""
WITH v AS (SELECT CASE user_id % 3 WHEN 0 THEN 'S0' WHEN 1 THEN 'S1' ELSE 'S2' END AS scenario_id, sum(value) AS total, max(value) AS peak FROM events GROUP BY 1),
d AS (SELECT v.*, v.total - b.total AS total_delta, 100 * (v.total - b.total) / b.total AS total_pct, v.peak - b.peak AS peak_delta, 100 * (v.peak - b.peak) / b.peak AS peak_pct FROM v, (SELECT * FROM v WHERE scenario_id = 'S0') b)
SELECT scenario_id, round(total_delta, 6) + 0.0 AS total_delta, round(total_pct, 6) + 0.0 AS total_pct, round(peak_delta, 6) + 0.0 AS peak_delta, round(peak_pct, 6) + 0.0 AS peak_pct,
  CASE WHEN scenario_id <> 'S0' THEN CASE WHEN abs(total_pct) >= abs(peak_pct) THEN 'total' ELSE 'peak' END END AS most_sensitive FROM d
""")
def scenario_compare(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("scenario_id", F.element_at(F.array(F.lit("S0"), F.lit("S1"), F.lit("S2")), (F.col("user_id") % 3 + 1).cast("int")))
    m = x.groupBy("scenario_id").agg(F.sum("value").alias("total"), F.max("value").alias("peak"))
    return rounded(scenario.compare(m, ["total", "peak"]).drop("total", "peak"))


@query("""
WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) - 1 AS l, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS t FROM events)
SELECT user_id, event_id FROM x WHERE t = 1 OR n IN (0, round(0.5 * l), l)
""")
def representative_times(spark, sf_dir):
    return guards.representative(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value"], (0.0, 0.5, 1.0), even=2).select("user_id", "event_id")


@query()
def header_audit(spark, sf_dir):
    names = ("events", "lineitem", "labels", "embeddings")
    return columns.audit(spark, {n: table(spark, sf_dir, n) for n in names}, ["value", "l_quantity", "embedding"], ["event_id", "l_orderkey", "doc_id", "vec_id"])


@query()
def varied_events(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("peak"), F.mode("event_type", True).alias("kind"))
    return spark.createDataFrame([(k,) for k in guards.varied_choice(x, "user_id", "peak", "kind", 5)], "user_id long")


SWEEP = [(k, cap, float(p)) for k, cap, p in ((10, 2, 0.5), (10, 3, 1.0), (20, 3, 1.0), (20, 5, 1.0))]


@query("""
WITH cfg(k, cap, p) AS (VALUES """ + ", ".join(map(str, SWEEP)) + """), """ + EDGES.split("WITH ")[1].split(",\nc AS")[0] + """,
c AS (SELECT cfg.k, cfg.cap, cfg.p, p.target_id, p.history_id, p.d, (row_number() OVER (PARTITION BY cfg.k, cfg.cap, cfg.p, target_id, g ORDER BY d, history_id) > cfg.cap)::INT AS over FROM p, cfg),
r AS (SELECT *, row_number() OVER (PARTITION BY k, cap, p, target_id ORDER BY over, d, history_id) AS r FROM c)
SELECT k::BIGINT AS k, cap::BIGINT AS cap, round(p::DOUBLE, 6) + 0.0 AS p, round(avg(d * p::DOUBLE), 6) + 0.0 AS mean_distance, count(*) AS n FROM r WHERE r <= k GROUP BY ALL
""")
def setting_sweep(spark, sf_dir):
    """All settings in one plan: each edge of the pool is looked at under each setting."""
    e = table(spark, sf_dir, "embeddings")
    pool = retrieval.neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", 100, slices=COMPONENTS, group="label", exclude="self")
    cfg = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("cap"), F.lit(p).alias("p")) for k, c, p in SWEEP])
    x = pool.withColumn("s", F.explode(cfg)).select(*pool.columns, "s.*")
    key = ["k", "cap", "p", "target_id"]
    x = x.withColumn("over", F.row_number().over(Window.partitionBy(*key, "history_group").orderBy("distance", "history_id")) > F.col("cap"))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("over", "distance", "history_id"))).where("r <= k")
    return rounded(x.groupBy("k", "cap", "p").agg(F.avg(F.col("distance") * F.col("p")).alias("mean_distance"), F.count("*").alias("n")))
