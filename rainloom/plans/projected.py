"""Queries on fields that are turned from a storm's own axes to the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.operators import grid
from rainloom.plans.registry import query, rounded, table

#: Every vector is a frame of 8 x 8 cells of 100 km about its storm; the storms of one label make one map of cells of half a degree.
HALF, STEP, DEGREES, MARGIN = 350.0, 100.0, 0.5, 4.0


@query(f"""
WITH t AS (SELECT vec_id, label, embedding, 120 + (vec_id % 13) * 0.37::DOUBLE AS lon, 15 + (vec_id % 7) * 0.53::DOUBLE AS lat, ((vec_id * 47) % 360)::DOUBLE + 0.25 AS heading FROM embeddings),
b AS (SELECT label, floor((min(lat) - {MARGIN}) / {DEGREES})::BIGINT AS a, ceil((max(lat) + {MARGIN}) / {DEGREES})::BIGINT AS b, floor((min(lon) - {MARGIN}) / {DEGREES})::BIGINT AS c, ceil((max(lon) + {MARGIN}) / {DEGREES})::BIGINT AS d FROM t GROUP BY label),
g AS (SELECT label, ilat, unnest(range(c, d + 1)) AS ilon FROM (SELECT *, unnest(range(a, b + 1)) AS ilat FROM b)),
e AS (SELECT vec_id, t.label, ilat, ilon, embedding, (ilon * {DEGREES} - lon) * 111.32 * cos(radians(lat)) AS e, (ilat * {DEGREES} - lat) * 111.32 AS n, radians(heading) AS h FROM t JOIN g ON t.label = g.label),
p AS (SELECT *, e * sin(h) + n * cos(h) AS ahead, -e * cos(h) + n * sin(h) AS port FROM e),
q AS (SELECT *, ({HALF} - port) / {STEP} AS r, (ahead + {HALF}) / {STEP} AS c FROM p WHERE abs(ahead) <= {HALF} AND abs(port) <= {HALF}),
w AS (SELECT vec_id, label, ilat, ilon, embedding, floor(r)::BIGINT AS r0, floor(c)::BIGINT AS c0, r - floor(r) AS fr, c - floor(c) AS fc FROM q),
v AS (SELECT label, ilat, ilon, vec_id, 10 * ((1 - fr) * (1 - fc) * abs(embedding[r0 * 8 + c0 + 1]::DOUBLE) + (1 - fr) * fc * coalesce(abs(embedding[r0 * 8 + c0 + 2]::DOUBLE), 0) + fr * (1 - fc) * coalesce(abs(embedding[r0 * 8 + c0 + 9]::DOUBLE), 0) + fr * fc * coalesce(abs(embedding[r0 * 8 + c0 + 10]::DOUBLE), 0)) AS rain FROM w)
SELECT label::BIGINT AS label, ilat, ilon, count(*) AS n_frames, round(sum(rain * 0.5), 6) + 0.0 AS total, round(max(rain), 6) + 0.0 AS peak, round(sum(CASE WHEN rain >= 1 THEN 0.5 ELSE 0 END)::DOUBLE, 6) + 0.0 AS hours_1 FROM v GROUP BY label, ilat, ilon
""")
def back_projection(spark, sf_dir):
    """Frames turned back to the map of their group and added up there: rain in all, the largest rate, and hours of rain."""
    v = F.col("vec_id")
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", (120 + (v % 13) * 0.37).alias("lon"), (15 + (v % 7) * 0.53).alias("lat"), (((v * 47) % 360).cast("double") + 0.25).alias("heading"))
    cells = grid.geographic_grid(t, ["label"], DEGREES, MARGIN)
    fields = t.select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 10).alias("rain"))
    x = grid.project_back(t.drop("embedding"), cells, fields, ["label"], "vec_id", "rain", HALF, STEP, DEGREES, packed=True)
    s = grid.accumulate(x.withColumn("n", F.lit(1)), ["label", "ilat", "ilon"], "rain", "vec_id", thresholds=(1,))
    n = x.groupBy("label", "ilat", "ilon").agg(F.count("*").alias("n_frames"))
    return rounded(s.join(n, ["label", "ilat", "ilon"]).select("label", "ilat", "ilon", "n_frames", "total", "peak", "hours_1"))
