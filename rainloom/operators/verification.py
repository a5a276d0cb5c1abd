"""Fields against the truth: every metric of every version of a field from one aggregate, and the choice among settings by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions.clean import safe_ratio
from rainloom.operators import retrieval
from rainloom.operators.aggregates import stability

#: Percentiles of a field.
LEVELS = (0.5, 0.75, 0.9, 0.95, 0.99)
#: Shares of the rain within the radii.
SHARES = (0.5, 0.8, 0.9)


def tag(threshold: float) -> str:
    """A threshold within a column's name: 0_5 for 0.5."""
    return f"{threshold:g}".replace(".", "_")


def _states(v: Column, x: Column, y: Column, thresholds: Sequence[float]) -> dict[str, Column]:
    """The mergeable state of one field: counts, sums and moments, its values' percentiles, and its rain by radius (a field is one grid, so that is bounded)."""
    w, some = F.when(v > 0, v), lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    part = lambda c: some(F.when(c, w))
    out = {"n": F.count(v), "mean": F.avg(v), "max": F.max(v), "q": F.percentile(v, F.array(*map(F.lit, LEVELS))), "n_wet": F.count(w)}
    out |= {f"at_{tag(t)}": F.count_if(v >= t) for t in thresholds}
    out |= {"w": some(w), "wx": some(w * x), "wy": some(w * y), "wxx": some(w * x * x), "wyy": some(w * y * y), "wxy": some(w * x * y)}
    out |= {"front": part(x > 0), "back": part(x < 0), "left": part(y > 0), "right": part(y < 0)}
    out |= {"front_left": part((x > 0) & (y > 0)), "front_right": part((x > 0) & (y < 0)), "back_left": part((x < 0) & (y > 0)), "back_right": part((x < 0) & (y < 0))}
    return out | {"rings": F.sort_array(F.collect_list(F.when(v > 0, F.struct(F.sqrt(x * x + y * y).alias("r"), v.cast("double").alias("w")))))}


def _radii(rings: Column, total: Column) -> Column:
    """The smallest radii within which the shares of the rain lie."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("s"), *[none.alias(f"r{i}") for i in range(len(SHARES))])

    def add(seen: Column, ring: Column) -> Column:
        s = seen["s"] + ring["w"]
        return F.struct(s.alias("s"), *[F.coalesce(seen[f"r{i}"], F.when(s >= q * total * (1 - 1e-12), ring["r"])).alias(f"r{i}") for i, q in enumerate(SHARES)])

    return F.aggregate(rings, start, add)


def _shape(c: str, area: float, thresholds: Sequence[float]) -> dict[str, Column]:
    """Metrics of a field from its state, whose columns begin with c."""
    g = lambda name: F.col(f"{c}{name}")
    cx, cy = safe_ratio(g("wx"), g("w")), safe_ratio(g("wy"), g("w"))
    sxx, syy, sxy = safe_ratio(g("wxx"), g("w")) - cx * cx, safe_ratio(g("wyy"), g("w")) - cy * cy, safe_ratio(g("wxy"), g("w")) - cx * cy
    out = {"mean": g("mean"), "max": g("max")} | {f"p{round(100 * q)}": g("q")[i] for i, q in enumerate(LEVELS)}
    out |= {"volume": g("mean") * g("n") * area} | {f"area_{tag(t)}": g(f"at_{tag(t)}") * area for t in thresholds}
    out |= {f"share_{tag(t)}": safe_ratio(g(f"at_{tag(t)}").cast("double"), g("n").cast("double")) for t in thresholds}
    out |= {"centroid_x": cx, "centroid_y": cy, "centroid_offset": F.sqrt(cx * cx + cy * cy)}
    out |= {"anisotropy": F.when(g("n_wet") >= 2, safe_ratio(F.sqrt(F.pow(sxx - syy, 2) + 4 * sxy * sxy), sxx + syy))}
    out |= {f"r{round(100 * q)}": g("radii")[f"r{i}"] for i, q in enumerate(SHARES)}
    out |= {"band_width": g("radii")[f"r{len(SHARES) - 1}"] - g("radii")["r0"], "front_back": safe_ratio(g("front"), g("back")), "left_right": safe_ratio(g("left"), g("right"))}
    return out | {f"{k}_share": safe_ratio(g(k), g("w")) for k in ("front_left", "front_right", "back_left", "back_right")}


def field_metrics(cells: DataFrame, by: Sequence[str], truth: str, versions: Mapping[str, str], x: str, y: str, area: float, thresholds: Sequence[float] = (1, 5, 10, 20), eps: float = 1e-12) -> DataFrame:
    """A row per field (by) and version: the field's own metrics; rmse, mae, bias and correlation over the cells that both have; csi, pod, far and f1 at
    each threshold; absolute and relative errors of maximum, tail percentiles and areas, distance of the centroids, and absolute errors of the shape.

    cells: a row per cell, with the truth and every version (name -> column) side by side; x and y in km ahead and left of the centre; area in km2 a cell.
    One aggregate, and so one shuffle of states summed before it, holds all versions and thresholds. Not-a-number counts as missing; metrics of
    fields without cells or rain are null, scores without events 0."""
    names = {"truth": truth, **versions}
    cols = {k: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for k, c in names.items()}
    at_x, at_y, t = F.col(x).cast("double"), F.col(y).cast("double"), cols["truth"]
    aggs = [state.alias(f"__{i}_{name}") for i, k in enumerate(names) for name, state in _states(cols[k], at_x, at_y, thresholds).items()]
    for i, k in list(enumerate(names))[1:]:
        p = cols[k]
        both = p.isNotNull() & t.isNotNull()
        d, p2, t2 = p - t, F.when(both, p), F.when(both, t)
        aggs += [c.alias(f"__{i}_{name}") for name, c in {"n_both": F.count(d), "mse": F.avg(d * d), "mae": F.avg(F.abs(d)), "bias": F.avg(d), "cov": F.covar_pop(p2, t2), "sp": F.stddev_pop(p2), "st": F.stddev_pop(t2)}.items()]
        for th in thresholds:
            hit, seen = F.coalesce(p >= th, F.lit(False)), F.coalesce(t >= th, F.lit(False))
            aggs += [F.count_if(c).alias(f"__{i}_{name}_{tag(th)}") for name, c in {"hits": hit & seen, "misses": ~hit & seen, "false": hit & ~seen}.items()]
    s = cells.groupBy(*by).agg(*aggs)
    s = s.withColumns({f"__{i}_radii": _radii(F.col(f"__{i}_rings"), F.col(f"__{i}_w")) for i in range(len(names))})
    base, rows = _shape("__0_", area, thresholds), []
    for i, k in enumerate(names):
        own = _shape(f"__{i}_", area, thresholds)
        if i:
            g = lambda name, i=i: F.col(f"__{i}_{name}")
            spread = (g("sp") > 1e-12) & (g("st") > 1e-12)
            own |= {"n_both": g("n_both"), "rmse": F.sqrt(g("mse")), "mae": g("mae"), "bias": g("bias"), "corr": F.when(spread, g("cov") / (g("sp") * g("st")))}
            for th in thresholds:
                h, m, f = (g(f"{name}_{tag(th)}") for name in ("hits", "misses", "false"))
                own |= {f"csi_{tag(th)}": h / (h + m + f + eps), f"pod_{tag(th)}": h / (h + m + eps), f"far_{tag(th)}": f / (h + f + eps), f"f1_{tag(th)}": 2 * h / (2 * h + m + f + eps)}
            for name in ("max", "p95", "p99", *[f"area_{tag(th)}" for th in thresholds]):
                own |= {f"{name}_error": F.abs(own[name] - base[name]), f"{name}_relative_error": safe_ratio(F.abs(own[name] - base[name]), F.abs(base[name]))}
            own["centroid_error"] = F.sqrt(F.pow(own["centroid_x"] - base["centroid_x"], 2) + F.pow(own["centroid_y"] - base["centroid_y"], 2))
            own |= {f"{name}_error": F.abs(own[name] - base[name]) for name in ("centroid_offset", "anisotropy", "r50", "r80", "r90", "band_width", "front_back", "left_right")}
            rows.append((k, own))
    out = F.array(*[F.struct(F.lit(k).alias("version"), *[c.cast("double").alias(name) for name, c in own.items()]) for k, own in rows])
    truths = [c.cast("double").alias(f"truth_{name}") for name, c in base.items()]
    return s.select(*by, *truths, F.explode(out).alias("__m")).select(*by, "__m.*", *[f"truth_{name}" for name in base])


def ablation(targets: DataFrame, history: DataFrame, key: str, vector: str, field: str, modes: Mapping[str, Mapping[str, tuple]], places: Sequence[tuple[float, float]], area: float, low: Sequence[str], high: Sequence[str], group: str | None = None, exclude: str = "self", pool: int = 1000, k: int = 20, cap: int = 3, thresholds: Sequence[float] = (10, 20)) -> DataFrame:
    """A row per mode (a set of features and their weights): how many targets it served, the means of its metrics over them, score and is_best.

    Every target is treated as if its field were missing: for each mode its field is the weighted mean of the fields of its nearest history rows (`pool` of
    them, at most `cap` a group among the k taken, softmax weights), held against its own. All modes are searched in one pass over history. targets and
    history: key, vector, field (an array, its cells at `places`: km ahead and left), group. low, high: metrics of `field_metrics` that choose the mode."""
    found = retrieval.neighbours_by_mode(targets, history, key, key, vector, pool, modes, group, exclude)
    by = ("mode", "target_id")
    edges = retrieval.softmax_weights(retrieval.diversified(found, k, cap, by), by=by).select(*by, "history_id", "similarity_weight")
    fields = lambda df, name: df.select(F.col(key).alias(name), F.posexplode(field).alias("i", "v"))
    x = edges.join(history.select(F.col(key).alias("history_id"), F.col(field).alias("f")), "history_id")
    cells = x.select(*by, "similarity_weight", F.posexplode("f").alias("i", "v")).where("v is not null")
    made = cells.groupBy(*by, "i").agg(safe_ratio(F.sum(F.col("similarity_weight") * F.col("v")), F.sum("similarity_weight")).alias("made"))
    at = F.element_at(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in places]), F.col("i") + 1)
    both = made.join(fields(targets, "target_id"), ["target_id", "i"]).withColumn("at", at)
    m = field_metrics(both.select(*by, "made", "v", "at.x", "at.y"), by, "v", {"made": "made"}, "x", "y", area, thresholds)
    means = m.groupBy("mode").agg(F.count("*").alias("n_targets"), *[F.avg(c).alias(c) for c in (*low, *high)])
    return choose(means, "mode", low, high)


def choose(scores: DataFrame, key: str, low: Sequence[str], high: Sequence[str] = ()) -> DataFrame:
    """scores (a row a setting) with `score`, the sum of the metrics scaled to [0, 1] over the settings, of which `low` ones are better low and `high` ones
    high, and `is_best` for the least sum (the smallest key of several). A metric without spread, or that is null, adds nothing."""
    x = scores.withColumns({f"__{m}": -F.col(m) for m in high})
    return stability(x, key, [*low, *[f"__{m}" for m in high]]).drop(*[f"__{m}" for m in high])
