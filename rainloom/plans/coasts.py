"""Queries on coasts from shape files and on land rasters: every supplier is an island with a lake, some of them across the date line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rainloom.functions import geo
from rainloom.operators import coast
from rainloom.plans.registry import query, rounded, table
from rainloom.sources.polygons import parse_shapes, shape_bytes

ISLANDS = """
WITH s AS (SELECT s_suppkey AS k, 150 + ((s_suppkey * 73) % 400) / 10.0::DOUBLE AS cx, ((s_suppkey * 37) % 300) / 10.0::DOUBLE AS cy, (1 + s_suppkey % 3)::DOUBLE AS r FROM supplier),
v AS (SELECT k, part, i, cx + dx * r * f AS x, cy + dy * r * f AS y FROM s, (VALUES (0, 0, 0.0, 1.0, 1.0), (0, 1, 1.0, 0.0, 1.0), (0, 2, 0.0, -1.0, 1.0), (0, 3, -1.0, 0.0, 1.0), (1, 0, 0.0, 1.0, 0.5), (1, 1, -1.0, 0.0, 0.5), (1, 2, 0.0, -1.0, 0.5), (1, 3, 1.0, 0.0, 0.5)) d(part, i, dx, dy, f)),
e AS (SELECT a.k AS land, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.k = b.k AND a.part = b.part AND b.i = (a.i + 1) % 4),
"""


def islands(spark, sf_dir):
    """The vertices of the islands, by way of shape files of 64 records."""
    s = F.col("s_suppkey")
    x = table(spark, sf_dir, "supplier").select(F.floor(s / 64).alias("file"), (150 + ((s * 73) % 400) / 10.0).alias("cx"), (((s * 37) % 300) / 10.0).alias("cy"), (1 + s % 3).cast("double").alias("r"))

    def encode(df: pd.DataFrame) -> pd.DataFrame:
        ring = lambda cx, cy, r, turn: [(cx, cy + r), (cx + turn * r, cy), (cx, cy - r), (cx - turn * r, cy)]
        records = [[ring(cx, cy, r, 1), ring(cx, cy, r / 2, -1)] for cx, cy, r in zip(df["cx"], df["cy"], df["r"], strict=True)]
        return pd.DataFrame({"path": [f"islands-{df['file'].iloc[0]}"], "content": [shape_bytes(records)]})

    # files are few bytes and much work, so their number of tasks doesn't go by their size
    x = x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return parse_shapes(x.groupBy("file").applyInPandas(encode, "path string, content binary"))


def places(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (((k * 73) % 4000) / 100.0 + 150.003).alias("lon"), (((k * 37) % 3000) / 100.0 + 0.007).alias("lat"))


PLACES = "p AS (SELECT c_custkey, ((c_custkey * 73) % 4000) / 100.0::DOUBLE + 150.003 AS x, ((c_custkey * 37) % 3000) / 100.0::DOUBLE + 0.007 AS y FROM customer)"
MX, MY = "radians({}) * 6378137.0", "ln(tan(radians({}) / 2 + pi() / 4)) * 6378137.0"


@query(ISLANDS + PLACES + f""",
m AS (SELECT land, {MX.format('x1')} AS x1, {MY.format('y1')} AS y1, {MX.format('x2')} AS x2, {MY.format('y2')} AS y2 FROM e), q AS (SELECT c_custkey, {MX.format('x')} AS x, {MY.format('y')} AS y FROM p),
d AS (SELECT c_custkey, x1 - x AS ax, y1 - y AS ay, x2 - x1 AS dx, y2 - y1 AS dy FROM q JOIN m ON least(x1, x2) - 100000 <= x AND greatest(x1, x2) + 100000 >= x AND least(y1, y2) - 100000 <= y AND greatest(y1, y2) + 100000 >= y),
n AS (SELECT c_custkey, min(sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)) AS m FROM (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM d) GROUP BY c_custkey),
h AS (SELECT c_custkey, land FROM p JOIN e ON ((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM h) AS on_land, CASE WHEN m <= 100000 THEN round(m * CASE WHEN c_custkey IN (SELECT c_custkey FROM h) THEN -1 ELSE 1 END, 3) + 0.0 END AS signed_coast_m FROM p LEFT JOIN n USING (c_custkey)
""")
def shape_coasts(spark, sf_dir):
    """Islands written as shape files and read again: whether a place is on land (lakes aren't), and its distance to the shore in projected metres, negative on land."""
    s = coast.shape_segments(islands(spark, sf_dir))
    p = coast.on_land(places(spark, sf_dir).withColumn("lon", geo.wrap180(F.col("lon"))), s).withColumn("east", F.pmod("lon", F.lit(360.0)))
    x, y = geo.mercator(F.col("east"), F.col("lat"))
    ends = {f"{c}{i}": e for i in (1, 2) for c, e in zip("xy", geo.mercator(F.col(f"x{i}"), F.col(f"y{i}")), strict=True)}
    d = coast.plane_distance(p.withColumns({"mx": x, "my": y}), s.withColumns(ends), 100_000.0, "mx", "my", 200_000.0)
    return d.select("c_custkey", "on_land", (F.round(F.when(F.col("on_land"), -F.col("coast_m")).otherwise(F.col("coast_m")), 3) + F.lit(0.0)).alias("signed_coast_m"))


@query(ISLANDS + PLACES + """,
c AS (SELECT c_custkey, (floor(x / 0.25) + 0.5) * 0.25 AS x, (floor(y / 0.25) + 0.5) * 0.25 AS y FROM p),
h AS (SELECT c_custkey, land FROM c JOIN e ON ((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM h) AS on_land FROM p
""")
def land_raster(spark, sf_dir):
    """Places looked up in the raster of all islands, of cells of a quarter of a degree."""
    cells = coast.land_cells(coast.shape_segments(islands(spark, sf_dir)), 0.25)
    return coast.in_cells(places(spark, sf_dir), cells, 0.25).select("c_custkey", "on_land")
