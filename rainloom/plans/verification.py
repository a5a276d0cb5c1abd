"""Queries on whole metric bundles and on ablations of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainloom.operators import verification
from rainloom.operators.verification import tag
from rainloom.plans.registry import query, rounded, table

THRESHOLDS = (0.5, 1.0, 2.0)
VERSIONS = {"initial": "a", "blended": "b", "calibrated": "c"}


def packed(spark, sf_dir):
    """Fields of 8 x 8 cells for every vector: the truth and three versions of it, with the places of the cells in km."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double")) * 10).alias("f"))
    x = e.select("vec_id", F.posexplode(F.arrays_zip(F.col("f").alias("t"), F.reverse("f").alias("a"))).alias("i", "c"))
    t, a = F.col("c.t"), F.col("c.a")
    return x.select("vec_id", ((F.col("i") % 8) * 100 - 350).alias("x"), (350 - F.floor(F.col("i") / 8) * 100).alias("y"), t.alias("t"), a.alias("a"), ((a + t) / 2).alias("b"), (t * 1.2 + 0.1).alias("c"))


def field_sql(v: str) -> str:
    """Metrics of the column v by field; wet sums over an empty set are 0."""
    part = lambda cond: f"coalesce(sum({v}) FILTER ({v} > 0 AND {cond}), 0)"
    return ", ".join(
        [f"avg({v}) AS mean, max({v}) AS max, avg({v}) * count({v}) * 0.25 AS volume, sum({v}) FILTER ({v} > 0) AS w, count(*) FILTER ({v} > 0) AS n_wet"]
        + [f"quantile_cont({v}, {q}) AS p{round(100 * q)}" for q in verification.LEVELS]
        + [f"count(*) FILTER ({v} >= {t}) * 0.25 AS area_{tag(t)}, count(*) FILTER ({v} >= {t})::DOUBLE / count({v}) AS share_{tag(t)}" for t in THRESHOLDS]
        + [f"sum({v} * {m}) FILTER ({v} > 0) / sum({v}) FILTER ({v} > 0) AS m{k}" for k, m in (("x", "x"), ("y", "y"), ("xx", "x * x"), ("yy", "y * y"), ("xy", "x * y"))]
        + [f"{part('x > 0')} AS front, {part('x < 0')} AS back, {part('y > 0')} AS lft, {part('y < 0')} AS rgt"]
        + [f"{part(f'x {p} 0 AND y {q} 0')} / sum({v}) FILTER ({v} > 0) AS {k}_share" for k, p, q in (("front_left", ">", ">"), ("front_right", ">", "<"), ("back_left", "<", ">"), ("back_right", "<", "<"))]
    )


def shape_sql(source: str) -> str:
    """A row per (vec_id, version) of metrics of the relation source (vec_id, version, x, y, v)."""
    return f"""
SELECT s.*, mx AS centroid_x, my AS centroid_y, sqrt(mx * mx + my * my) AS centroid_offset, CASE WHEN n_wet >= 2 THEN sqrt(((mxx - mx * mx) - (myy - my * my)) ** 2 + 4 * (mxy - mx * my) ** 2) / ((mxx - mx * mx) + (myy - my * my)) END AS anisotropy,
  CASE WHEN back > 1e-12 THEN front / back END AS front_back, CASE WHEN rgt > 1e-12 THEN lft / rgt END AS left_right, r50, r80, r90, r90 - r50 AS band_width
FROM (SELECT vec_id, version, {field_sql('v')} FROM {source} GROUP BY vec_id, version) s LEFT JOIN (
  SELECT vec_id, version, min(r) FILTER (upto >= 0.5 * w * (1 - 1e-12)) AS r50, min(r) FILTER (upto >= 0.8 * w * (1 - 1e-12)) AS r80, min(r) FILTER (upto >= 0.9 * w * (1 - 1e-12)) AS r90 FROM (
    SELECT vec_id, version, sqrt((x * x + y * y)::DOUBLE) AS r, sum(v) OVER (PARTITION BY vec_id, version ORDER BY sqrt((x * x + y * y)::DOUBLE), v ROWS UNBOUNDED PRECEDING) AS upto, sum(v) OVER (PARTITION BY vec_id, version) AS w FROM {source} WHERE v > 0) GROUP BY vec_id, version) USING (vec_id, version)"""


SHAPE = ["mean", "max", *[f"p{round(100 * q)}" for q in verification.LEVELS], "volume", *[f"{k}_{tag(t)}" for k in ("area", "share") for t in THRESHOLDS], "centroid_x", "centroid_y", "centroid_offset", "anisotropy", "r50", "r80", "r90", "band_width", "front_back", "left_right", "front_left_share", "front_right_share", "back_left_share", "back_right_share"]
TAILS = ["max", "p95", "p99", *[f"area_{tag(t)}" for t in THRESHOLDS]]
SINGLE = ["centroid_offset", "anisotropy", "r50", "r80", "r90", "band_width", "front_back", "left_right"]
SCORES = ", ".join(
    f"count(*) FILTER (v >= {t} AND t >= {t}) AS h{i}, count(*) FILTER (v < {t} AND t >= {t}) AS m{i}, count(*) FILTER (v >= {t} AND t < {t}) AS f{i}" for i, t in enumerate(THRESHOLDS)
)
RATES = [(f"{k}_{tag(t)}", sql) for i, t in enumerate(THRESHOLDS) for k, sql in (("csi", f"h{i} / (h{i} + m{i} + f{i} + 1e-12)"), ("pod", f"h{i} / (h{i} + m{i} + 1e-12)"), ("far", f"f{i} / (h{i} + f{i} + 1e-12)"), ("f1", f"2 * h{i} / (2 * h{i} + m{i} + f{i} + 1e-12)"))]
METRICS = (
    {m: f"a.{m}" for m in SHAPE}
    | {m: f"e.{m}" for m in ("n_both", "rmse", "mae", "bias", "corr")}
    | dict(RATES)
    | {f"{m}_error": f"abs(a.{m} - b.{m})" for m in TAILS + SINGLE}
    | {f"{m}_relative_error": f"CASE WHEN abs(b.{m}) > 1e-12 THEN abs(a.{m} - b.{m}) / abs(b.{m}) END" for m in TAILS}
    | {"centroid_error": "sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2)"}
    | {f"truth_{m}": f"b.{m}" for m in SHAPE}
)
FIELDS = """
WITH c AS (SELECT vec_id, (i % 8) * 100 - 350 AS x, 350 - (i // 8) * 100 AS y, abs(embedding[i + 1]::DOUBLE) * 10 AS t, abs(embedding[64 - i]::DOUBLE) * 10 AS a FROM embeddings, range(64) r(i)),
"""
BUNDLE = f"""
l AS (SELECT vec_id, x, y, t, unnest([{{'version': 'truth', 'v': t}}, {{'version': 'initial', 'v': a}}, {{'version': 'blended', 'v': (a + t) / 2}}, {{'version': 'calibrated', 'v': t * 1.2 + 0.1}}], recursive := true) FROM c),
g AS ({shape_sql('l')}),
e AS (SELECT vec_id, version, count(*) AS n_both, sqrt(avg((v - t) ** 2)) AS rmse, avg(abs(v - t)) AS mae, avg(v - t) AS bias, corr(v, t) AS corr, {SCORES} FROM l GROUP BY ALL)
SELECT a.vec_id, a.version, {', '.join(f'round(({sql})::DOUBLE, 6) + 0.0 AS {m}' for m, sql in METRICS.items())} FROM g a JOIN g b ON a.vec_id = b.vec_id AND b.version = 'truth' JOIN e ON e.vec_id = a.vec_id AND e.version = a.version WHERE a.version <> 'truth'
"""


@query(FIELDS + BUNDLE)
def field_metric_bundle(spark, sf_dir):
    """Three versions of every field against the truth, with every metric."""
    return rounded(verification.field_metrics(packed(spark, sf_dir), ["vec_id"], "t", VERSIONS, "x", "y", 0.25, THRESHOLDS))


MODES = {
    "base": {"track": (slice(0, 16), 1.0), "intensity": (slice(16, 32), 1.5)},
    "full": {"track": (slice(0, 16), 1.0), "intensity": (slice(16, 32), 1.5), "environment": (slice(32, 64), 1.2)},
    "key": {"track": (slice(0, 16), 1.0), "intensity": (slice(16, 32), 1.5), "environment": ([32, 40, 48, 56], 1.2)},
}
LOW, HIGH = ["rmse", "mae", "p95_error", "p99_error", "max_error", "area_1_error", "area_2_error"], ["corr", "csi_1", "f1_1"]
PLACES = [((i % 8) * 100 - 350, 350 - (i // 8) * 100) for i in range(64)]


def mode_sql(parts: dict) -> str:
    """The distance of a mode in SQL."""
    at = {name: list(range(64))[p] if isinstance(p, slice) else p for name, (p, _) in parts.items()}
    return " + ".join(f"{parts[n][1]} * list_sum([(a.embedding[i + 1]::DOUBLE - b.embedding[i + 1]::DOUBLE) ** 2 FOR i IN {places}]) / {len(places)}" for n, places in at.items())


SPAN = " + ".join([f"coalesce(({m} - min({m}) OVER ()) / nullif(max({m}) OVER () - min({m}) OVER (), 0), 0)" for m in LOW] + [f"coalesce((max({m}) OVER () - {m}) / nullif(max({m}) OVER () - min({m}) OVER (), 0), 0)" for m in HIGH])


@query(
    "WITH d AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS mode, a.vec_id AS target_id, b.vec_id AS history_id, b.label AS g, {mode_sql(parts)} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0" for m, parts in MODES.items())
    + f"""),
p AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY mode, target_id ORDER BY d, history_id) <= 100),
q AS (SELECT *, (row_number() OVER (PARTITION BY mode, target_id, g ORDER BY d, history_id) > 3)::INT AS over FROM p),
k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY mode, target_id ORDER BY over, d, history_id) <= 20),
w AS (SELECT *, exp(-(d - min(d) OVER (PARTITION BY mode, target_id)) / quantile_cont(d, 0.5) OVER (PARTITION BY mode, target_id)) AS e FROM k),
l AS (SELECT mode AS version, target_id AS vec_id, (i % 8) * 100 - 350 AS x, 350 - (i // 8) * 100 AS y, sum(e * abs(h.embedding[i + 1]::DOUBLE) * 10) / sum(e) AS v, any_value(abs(o.embedding[i + 1]::DOUBLE) * 10) AS t
  FROM w JOIN embeddings h ON h.vec_id = history_id JOIN embeddings o ON o.vec_id = target_id, range(64) r(i) GROUP BY ALL),
a AS ({shape_sql('l')}), u AS (SELECT version, vec_id, x, y, t AS v FROM l), b AS ({shape_sql('u')}),
e AS (SELECT vec_id, version, count(*) AS n_both, sqrt(avg((v - t) ** 2)) AS rmse, avg(abs(v - t)) AS mae, avg(v - t) AS bias, corr(v, t) AS corr, {SCORES} FROM l GROUP BY ALL),
m AS (SELECT a.vec_id, a.version, {', '.join(f'{METRICS[m]} AS {m}' for m in LOW + HIGH)} FROM a JOIN b USING (vec_id, version) JOIN e USING (vec_id, version)),
s AS (SELECT version AS mode, count(*) AS n_targets, {', '.join(f'avg({m}) AS {m}' for m in LOW + HIGH)} FROM m GROUP BY version),
z AS (SELECT *, {SPAN} AS score FROM s)
SELECT mode, n_targets, {', '.join(f'round({m}, 4) + 0.0 AS {m}' for m in LOW + HIGH)}, round(score, 4) + 0.0 AS score, row_number() OVER (ORDER BY score, mode) = 1 AS is_best FROM z"""
)
def feature_ablation(spark, sf_dir):
    """Three sets of features, each judged by the fields that its neighbours give, all searched in one pass over history."""
    e = table(spark, sf_dir, "embeddings").withColumn("field", F.transform("embedding", lambda v: F.abs(v.cast("double")) * 10))
    x = verification.ablation(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "field", MODES, PLACES, 0.25, LOW, HIGH, "label", pool=100, thresholds=THRESHOLDS)
    return x.select("mode", "n_targets", *[(F.round(m, 4) + F.lit(0.0)).alias(m) for m in [*LOW, *HIGH, "score"]], "is_best")
