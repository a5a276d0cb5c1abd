"""Queries on the whole calibration with its diagnostics, and on filling gaps with provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.operators import calibration
from rainloom.plans.registry import query, rounded, table

#: Fields: a supplier's line items. One in eight is all zero, one has rain in one cell alone, and one each lacks the targets of percentiles, area or all.
CELLS = """
WITH c AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 8 = 0 THEN 0 WHEN l_suppkey % 8 = 1 AND row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber) > 1 THEN -1 WHEN l_suppkey % 8 = 2 AND l_quantity < 30 THEN NULL WHEN l_suppkey % 8 = 7 THEN l_quantity / 4 ELSE l_quantity / 2 END::DOUBLE AS raw FROM lineitem),
v AS (SELECT *, CASE WHEN raw > 0 THEN raw ELSE 0 END AS v FROM c),
t AS (SELECT DISTINCT l_suppkey AS k, CASE WHEN l_suppkey % 8 NOT IN (3, 4) THEN 20.0 + l_suppkey % 5 END AS p95, CASE WHEN l_suppkey % 8 <> 4 THEN 26.0 END AS p99, CASE WHEN l_suppkey % 8 <> 4 THEN 20.0 + l_suppkey % 40 END AS top, CASE WHEN l_suppkey % 8 <> 5 THEN 25.0 * (l_suppkey % 7) * 10 END AS area, CASE WHEN l_suppkey % 3 > 0 THEN 30.0 END AS cap FROM lineitem WHERE l_suppkey % 8 <> 6),
"""


def clip(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def part(a: str, b: str, fa: str, fb: str) -> str:
    return f"CASE WHEN {b} > {a} + 1e-12 THEN {fa} + ({fb} - {fa}) * (v - {a}) / ({b} - {a}) ELSE 1 END"


F95, F99, FTOP = clip("y95 / q95", 0.7, 3), clip("y99 / q99", 0.7, 3), clip("ytop / top", 0.7, 5)
STAGES = CELLS + f"""
a AS (SELECT k, count(*) AS n, quantile_cont(v, 0.9) AS q90, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.99) AS q99, max(v) AS top FROM v GROUP BY k),
b AS (SELECT a.*, t.area, least(120.0, coalesce(t.cap, 120.0))::DOUBLE AS cap, coalesce(t.p95, q95) AS p95, greatest(coalesce(t.p99, q99), coalesce(t.p95, q95)) AS p99, greatest(coalesce(t.top, a.top), coalesce(t.p99, q99), coalesce(t.p95, q95)) AS ttop,
  a.top > 1e-12 AND q95 > 1e-12 AND q99 > 1e-12 AS scale,
  CASE WHEN a.top <= 0 THEN 'all_zero' WHEN q95 <= 1e-12 OR q99 <= 1e-12 THEN 'tail_too_small' WHEN t.p95 IS NULL OR t.p99 IS NULL OR t.top IS NULL OR t.area IS NULL THEN 'missing_targets:' || concat_ws(',', CASE WHEN t.p95 IS NULL THEN 'p95' END, CASE WHEN t.p99 IS NULL THEN 'p99' END, CASE WHEN t.top IS NULL THEN 'top' END, CASE WHEN t.area IS NULL THEN 'area' END) ELSE '' END AS issue
  FROM a LEFT JOIN t USING (k)),
y1 AS (SELECT *, least(greatest(q95 * {clip('p95 / (q95 + 1e-12)', 0.7, 3)}, q90), cap) AS y95 FROM b),
y2 AS (SELECT *, least(greatest(q99 * {clip('p99 / (q99 + 1e-12)', 0.7, 3)}, y95), cap) AS y99 FROM y1),
y3 AS (SELECT *, least(greatest(top * {clip('ttop / (top + 1e-12)', 0.7, 5)}, y99), cap) AS ytop FROM y2),
r AS (SELECT v.*, s.* EXCLUDE (k), CASE WHEN NOT scale OR v <= q90 THEN v WHEN v <= q95 THEN v * ({part('q90', 'q95', '1', F95)}) WHEN v <= q99 THEN v * ({part('q95', 'q99', F95, F99)}) ELSE v * ({part('q99', 'top', F99, FTOP)}) END AS r FROM v JOIN y3 s USING (k)),
h AS (SELECT k, count(*) FILTER (r >= 10) AS n10, count(*) FILTER (r >= 7 AND r < 10) AS nnear, quantile_cont(r, 0.99) AS r99 FROM r GROUP BY k),
m AS (SELECT r.*, h.* EXCLUDE (k), scale AND area IS NOT NULL AND NOT (area <= 25 AND n10 * 25.0 <= 25) AS open, greatest(1, floor(0.05 * n)) AS most FROM r JOIN h USING (k)),
u AS (SELECT *, CASE WHEN open AND n10 * 25.0 < area * 0.75 THEN ceil((area * 0.75 - n10 * 25.0) / 25.0) ELSE 0 END AS need, CASE WHEN open AND n10 * 25.0 > area * 1.25 THEN least(n10 - floor(area * 1.25 / 25.0), most) ELSE 0 END AS down FROM m),
w AS (SELECT *, need > 0 AND r < 10 AND r >= CASE WHEN nnear < need THEN 5 ELSE 7 END AS rise, down > 0 AND r >= 10 AND r < greatest(20, r99) AS fall FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY k, rise, fall ORDER BY CASE WHEN rise THEN -r ELSE r END, l_orderkey, l_partkey, l_linenumber) AS place FROM w),
z AS (SELECT *, rise AND place <= least(need, most) AS raised, fall AND place <= down AS lowered FROM p),
o AS (SELECT *, CASE WHEN NOT scale THEN v ELSE least(cap, CASE WHEN raised THEN 10 + 0.05 * least(greatest((r - 5) / 5, 0), 1) WHEN lowered THEN least(9.99, r * 0.97) ELSE r END) END AS out FROM z)
"""


def rained(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("l_suppkey")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    alone = k % 8 == 1  # only these fields' cells are put in order
    raw = F.when(k % 8 == 0, 0.0).when((k % 8 == 2) & (F.col("l_quantity") < 30), None).when(k % 8 == 7, F.col("l_quantity") / 4).otherwise(F.col("l_quantity") / 2)
    parts = (items.where(~alone).withColumn("raw", raw), items.where(alone).withColumn("raw", F.when(F.row_number().over(order) > 1, -1.0).otherwise(F.col("l_quantity") / 2)))
    cells = parts[0].unionAll(parts[1]).select(k.alias("k"), "l_orderkey", "l_linenumber", "l_partkey", F.col("raw").cast("double").alias("raw"))
    t = items.select(k.alias("k")).where("k % 8 <> 6").distinct()
    k = F.col("k")
    targets = t.select("k", F.when(~(k % 8).isin(3, 4), 20.0 + k % 5).alias("p95"), F.when(k % 8 != 4, 26.0).alias("p99"), F.when(k % 8 != 4, 20.0 + k % 40).alias("top"), F.when(k % 8 != 5, 25.0 * (k % 7) * 10).alias("area"), F.when(k % 3 > 0, 30.0).alias("cap"))
    return calibration.calibrate(cells, targets, "k", "raw", 25.0, ["l_orderkey", "l_partkey", "l_linenumber"])


@query(STAGES + "SELECT k, l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, round(out, 6) + 0.0 AS calibrated, CASE WHEN raised THEN 'raised' WHEN lowered THEN 'lowered' END AS step FROM o")
def calibrated_cells(spark, sf_dir):
    return rounded(rained(spark, sf_dir).select("k", "l_orderkey", "l_partkey", "l_linenumber", "calibrated", "step"))


@query(STAGES + """
SELECT k, max(CASE WHEN issue <> '' THEN 1 ELSE 0 END) = 0 AS ok, max(issue) AS issue, round(max(q95), 6) + 0.0 AS p95_before, round(max(q99), 6) + 0.0 AS p99_before, round(max(top), 6) + 0.0 AS top_before, round(quantile_cont(out, 0.95), 6) + 0.0 AS p95_after, round(quantile_cont(out, 0.99), 6) + 0.0 AS p99_after,
  round(max(out), 6) + 0.0 AS top_after, round(max(cap), 6) + 0.0 AS cap, count(*) FILTER (raw >= 10) * 25.0::DOUBLE AS area_before, count(*) FILTER (out >= 10) * 25.0::DOUBLE AS area_after, count(*) FILTER (raised) AS n_raised, count(*) FILTER (lowered) AS n_lowered, count(*) FILTER (scale AND out >= cap) AS n_at_cap
FROM o GROUP BY k""")
def calibration_diagnostics(spark, sf_dir):
    """A row per field: what the calibration met, did and left alone."""
    return rounded(calibration.diagnose(rained(spark, sf_dir), "k", "raw", 25.0))
