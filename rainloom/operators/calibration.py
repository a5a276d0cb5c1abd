"""Calibration of synthetic fields by the statistics of their analogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.clean import clipped, safe_ratio


def winsorised_means(edges: DataFrame, values: Sequence[str], weight: str = "similarity_weight", lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """A row per target: weighted means of values pulled in to the target's own [lo, hi] percentiles."""
    q = edges.groupBy("target_id").agg(*[F.percentile(v, F.array(F.lit(lo), F.lit(hi))).alias(f"__q_{v}") for v in values])
    x = edges.join(q, "target_id")
    pulled = {v: clipped(F.col(v), F.col(f"__q_{v}")[0], F.col(f"__q_{v}")[1]) for v in values}
    return x.groupBy("target_id").agg(*[safe_ratio(F.sum(F.when(pulled[v].isNotNull(), F.col(weight) * pulled[v])), F.sum(F.when(pulled[v].isNotNull(), F.col(weight)))).alias(v) for v in values])


def cap_targets(targets: DataFrame, p95: str, p99: str, top: str, limit: float = 120.0, factor: float = 1.25) -> DataFrame:
    """p99 at least p95, top at least p99, and a physical cap: the smaller of the limit and so many times the top."""
    t = targets.withColumn(p99, F.greatest(p99, p95)).withColumn(top, F.greatest(top, p99))
    return t.withColumn("cap", F.least(F.lit(limit), factor * F.col(top)))


def _beside(cells: DataFrame, fields: DataFrame, key: str, shares: int = 32) -> DataFrame:
    """cells with the columns of their field (a row a field in fields). Each field's cells are shared out by their hash, so that few large fields don't make few large tasks."""
    x = cells.withColumn("__share", F.pmod(F.xxhash64(*[F.col(c) for c in cells.columns]), F.lit(shares)).cast("int"))
    return x.join(fields.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), [key, "__share"]).drop("__share")


def scale_tail(cells: DataFrame, targets: DataFrame, key: str, value: str, lo: float = 0.7, hi: float = 3.0, hi_top: float = 5.0) -> DataFrame:
    """Values above the field's q90 are scaled so that its q95, q99 and maximum come to the targets' (columns p95, p99, top, cap).

    The factor is 1 at q90 and linear between the anchors; each anchor's factor stays within [lo, hi], the maximum's within [lo, hi_top]."""
    q = cells.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.90), F.lit(0.95), F.lit(0.99))).alias("q"), F.max(value).alias("m"))
    t = q.join(targets, key)
    factor = lambda want, have, most: clipped(F.coalesce(safe_ratio(want, have), F.lit(1.0)), lo, most)
    t = t.select(key, F.col("q")[0].alias("a0"), F.col("q")[1].alias("a1"), F.col("q")[2].alias("a2"), F.col("m").alias("a3"), factor(F.col("p95"), F.col("q")[1], hi).alias("f1"), factor(F.col("p99"), F.col("q")[2], hi).alias("f2"), factor(F.col("top"), F.col("m"), hi_top).alias("f3"), "cap")
    x, v = _beside(cells, t, key), F.col(value)
    between = lambda a, b, fa, fb: fa + (fb - fa) * F.coalesce(safe_ratio(v - F.col(a), F.col(b) - F.col(a)), F.lit(1.0))
    scale = F.when(v <= F.col("a0"), 1.0).when(v <= F.col("a1"), between("a0", "a1", F.lit(1.0), F.col("f1"))).when(v <= F.col("a2"), between("a1", "a2", F.col("f1"), F.col("f2"))).otherwise(between("a2", "a3", F.col("f2"), F.col("f3")))
    return x.withColumn(value, F.when(v.isNotNull(), F.least(v * scale, F.coalesce("cap", F.lit(float("inf")))))).select(*cells.columns)


def match_area(cells: DataFrame, targets: DataFrame, key: str, value: str, area: Column, want: str, threshold: float = 10.0, tolerance: float = 0.25, most: float = 0.05, tie: Sequence[str] = ()) -> DataFrame:
    """Where a field's area at or above the threshold misses the target's `want` by more than the tolerance, the cells nearest to the threshold are
    raised to it or pushed just below, as many as the gap needs, and no more than the share `most` of all cells. `changed` marks them."""
    a = cells.withColumn("__a", area)
    s = a.groupBy(key).agg(F.sum(F.when(F.col(value) >= threshold, F.col("__a")).otherwise(0.0)).alias("__have"), F.avg("__a").alias("__cell"), F.count("*").alias("__n"))
    s = s.join(targets.select(key, F.col(want).alias("__want")), key, "left")
    gap = F.col("__want") - F.col("__have")
    needed = F.when(F.abs(gap) > tolerance * F.col("__want"), F.least(F.round(F.abs(gap) / F.col("__cell")), F.floor(most * F.col("__n")))).otherwise(0).cast("long")
    s = s.select(key, F.coalesce(needed, F.lit(0).cast("long")).alias("__k"), (gap > 0).alias("__up"))
    x = a.join(s, key, "left")
    fits = (F.col("__k") > 0) & F.when(F.col("__up"), (F.col(value) < threshold) & (F.col(value) > 0)).otherwise(F.col(value) >= threshold)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.when(fits, 0).otherwise(1), F.abs(F.col(value) - threshold), *tie))
    x = x.withColumn("changed", F.coalesce(fits & (place <= F.col("__k")), F.lit(False)))
    new = F.when(~F.col("changed"), F.col(value)).when(F.col("__up"), F.lit(float(threshold))).otherwise(F.lit(threshold - 0.01))
    return x.withColumn(value, new).select(*cells.columns, "changed")


#: Why a field passes the calibration unchanged, or only partly calibrated.
ALL_ZERO, TINY_TAIL, NO_TARGETS, NOW_ZERO = "all_zero", "tail_too_small", "missing_targets", "calibrated_all_zero"


def field_state(cells: DataFrame, targets: DataFrame, key: str, value: str, limit: float = 120.0, lo: float = 0.7, hi: float = 3.0, hi_top: float = 5.0, eps: float = 1e-12, count: str | None = None) -> DataFrame:
    """(key, state): what the calibration knows of each field of cells before it touches one.

    state: n, q90, q95, q99, top (of the field), y95, y99, ytop (where they shall come to: the targets' p95, p99 and top, else the field's own; in order; within
    the factors' bounds; not above cap), cap (the target's, at most `limit`), area (the target's, or null), scale (whether the tail is scaled at all), issue.
    targets: key, p95, p99, top, area, cap; a field without a row there has none. A target that is missing or not finite falls back, and the issue names it.
    count: the column that says for how many cells a row of cells stands, if for more than one."""
    times = F.col(count) if count else F.lit(1).cast("long")
    s = cells.groupBy(key).agg(F.sum(times).alias("n"), F.percentile(value, F.array(F.lit(0.90), F.lit(0.95), F.lit(0.99)), times).alias("q"), F.max(value).alias("top"))
    want = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")).alias(f"t_{c}") for c in ("p95", "p99", "top", "area", "cap")}
    s = s.withColumnRenamed("top", "own_top").join(targets.select(key, *want.values()), key, "left")
    q95, q99, top = F.col("q")[1], F.col("q")[2], F.col("own_top")
    zero, tiny = top <= 0, (q95 <= eps) | (q99 <= eps) | (top <= eps)
    missing = F.array_compact(F.array(*[F.when(F.col(f"t_{c}").isNull(), c) for c in ("p95", "p99", "top", "area")]))
    issue = F.when(zero, ALL_ZERO).when(tiny, TINY_TAIL).when(F.size(missing) > 0, F.concat(F.lit(f"{NO_TARGETS}:"), F.array_join(missing, ",")))
    cap = F.least(F.lit(limit), F.when(F.col("t_cap") > 0, F.col("t_cap")))
    p95 = F.coalesce("t_p95", q95)
    p99 = F.greatest(F.coalesce("t_p99", q99), p95)
    end = F.greatest(F.coalesce("t_top", top), p99)
    s = s.withColumns({"cap": cap, "y0": q95 * clipped(p95 / (q95 + eps), lo, hi), "y1": q99 * clipped(p99 / (q99 + eps), lo, hi), "y2": top * clipped(end / (top + eps), lo, hi_top)})
    y95 = F.least(F.greatest("y0", F.col("q")[0]), "cap")
    y99 = F.least(F.greatest(F.col("y1"), y95), "cap")
    ytop = F.least(F.greatest(F.col("y2"), y99), "cap")
    fields = {"n": F.col("n"), "q90": F.col("q")[0], "q95": q95, "q99": q99, "top": top, "y95": y95, "y99": y99, "ytop": ytop, "cap": F.col("cap"), "area": F.col("t_area"), "scale": ~(zero | tiny), "issue": issue}
    return s.select(key, F.struct(*[c.alias(name) for name, c in fields.items()]).alias("state"))


def _tail_factor(v: Column, s: Column, lo: float, hi: float, hi_top: float, eps: float) -> Column:
    """1 up to q90, then linear between the anchors' factors; 1 where two anchors coincide."""
    f95, f99, ftop = (clipped(F.coalesce(safe_ratio(s[a], s[b]), F.lit(1.0)), lo, most) for a, b, most in (("y95", "q95", hi), ("y99", "q99", hi), ("ytop", "top", hi_top)))
    part = lambda a, b, fa, fb: F.when(s[b] > s[a] + eps, fa + (fb - fa) * (v - s[a]) / (s[b] - s[a])).otherwise(1.0)
    return F.when(v <= s["q90"], 1.0).when(v <= s["q95"], part("q90", "q95", F.lit(1.0), f95)).when(v <= s["q99"], part("q95", "q99", f95, f99)).otherwise(part("q99", "top", f99, ftop))


def calibrate(cells: DataFrame, targets: DataFrame, key: str, value: str, cell_area: float, tie: Sequence[str], limit: float = 120.0, lo: float = 0.7, hi: float = 3.0, hi_top: float = 5.0, threshold: float = 10.0, high: float = 20.0, near: tuple[float, float] = (7.0, 5.0), tolerance: float = 0.25, most: float = 0.05, eps: float = 1e-12) -> DataFrame:
    """cells with `calibrated`, `step` (raised, lowered, or null) and `state` (see field_state), stage by stage; nothing stops at a field that can't be calibrated.

    1. Values that are missing, not finite or negative become 0. 2. The tail above q90 is scaled to the state's anchors. 3. Where the area at or above
    the threshold misses the target's by more than the tolerance, the cells nearest below the threshold (from near[0] on, or near[1] if those are too
    few) are raised to it, or the nearest above it (below `high` or the field's q99) lowered, no more than the share `most` of all cells. 4. Values end at
    the cap. Fields that are all zero or whose tail is too small pass stages 2 to 4 with the values of stage 1, their issue in the state; so the state stays beside
    the cells and `diagnose` sums it up. tie: columns that order the cells of one value. cell_area: km2.

    What a field needs is found from the counts of its values, as is the value up to which cells move. Only the cells of that one value are put in order; all
    others meet their field's numbers by a hash join and are never sorted."""
    v = F.col(value).cast("double")
    x = cells.withColumn("__v", F.when((F.abs(v) < float("inf")) & (v > 0), v).otherwise(0.0))
    counts = x.groupBy(key, "__v").agg(F.count("*").alias("__c")).persist()
    states = field_state(counts, targets, key, "__v", limit, lo, hi, hi_top, eps, "__c").persist()
    s, r = F.col("state"), F.col("__r")
    tail = F.when(s["scale"], F.col("__v") * _tail_factor(F.col("__v"), s, lo, hi, hi_top, eps)).otherwise(F.col("__v"))
    scaled = counts.join(states.hint("shuffle_hash"), key).select(key, "__v", tail.alias("__r"), "__c").persist()
    how_many = lambda c: F.coalesce(F.sum(F.when(c, F.col("__c"))), F.lit(0))
    now = scaled.groupBy(key).agg(how_many(r >= threshold).alias("__at"), how_many((r >= near[0]) & (r < threshold)).alias("__near"), F.percentile("__r", F.lit(0.99), F.col("__c")).alias("__q99"))
    have, want, cells_most = F.col("__at") * cell_area, s["area"], F.greatest(F.lit(1), F.floor(most * s["n"]))
    open_ = s["scale"] & want.isNotNull() & ~((want <= cell_area) & (have <= cell_area))
    needed = F.ceil((want * (1 - tolerance) - have) / cell_area)
    raise_ = F.when(open_ & (have < want * (1 - tolerance)), F.least(needed, cells_most)).otherwise(0)
    lower = F.when(open_ & (have > want * (1 + tolerance)), F.least(F.col("__at") - F.floor(want * (1 + tolerance) / cell_area), cells_most)).otherwise(0)
    floor_ = F.when(F.col("__near") < needed, near[1]).otherwise(near[0])
    fields = states.join(now, key).select(key, "state", raise_.cast("long").alias("__up"), lower.cast("long").alias("__down"), floor_.alias("__floor"), F.greatest(F.lit(high), F.col("__q99")).alias("__high"))
    can_rise, can_fall = (F.col("__up") > 0) & (r >= F.col("__floor")) & (r < threshold), (F.col("__down") > 0) & (r >= threshold) & (r < F.col("__high"))
    order, k = F.when(can_rise, -r).when(can_fall, r), F.greatest("__up", "__down")  # a field rises or falls
    movable = scaled.join(fields.where(k > 0).drop("state").hint("shuffle_hash"), key).where(can_rise | can_fall).groupBy(key, order.alias("__o"), k.alias("__k")).agg(F.sum("__c").alias("__c"), F.collect_list("__v").alias("__vs"))
    movable = movable.withColumn("__upto", F.sum("__c").over(Window.partitionBy(key).orderBy("__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    within = F.col("__upto") <= F.col("__k")
    # all cells up to __whole move, and of those with the values __edge (almost always one) the first __room
    ends = movable.groupBy(key, "__k").agg(F.max(F.when(within, F.col("__o"))).alias("__whole"), F.min_by("__vs", F.when(~within, F.col("__o"))).alias("__edge"), (F.col("__k") - F.coalesce(F.max(F.when(within, F.col("__upto"))), F.lit(0))).alias("__room")).drop("__k")
    # kept, so that the tasks of the cells hold none of the steps above
    fields = fields.join(ends, key, "left").persist()
    x = x.join(fields.hint("shuffle_hash"), key)
    at_edge = F.coalesce((F.col("__room") > 0) & F.array_contains("__edge", F.col("__v")), F.lit(False))
    ties = x.where(at_edge).withColumn("__moves", F.row_number().over(Window.partitionBy(key).orderBy(*tie)) <= F.col("__room")).withColumn("__r", tail)
    rest = x.where(~at_edge).withColumn("__r", tail)
    x = rest.withColumn("__moves", F.coalesce(order <= F.col("__whole"), F.lit(False))).unionByName(ties)
    x = x.withColumn("step", F.when(F.col("__moves"), F.when(can_rise, "raised").otherwise("lowered")))
    share = clipped((r - near[1]) / (threshold - near[1]), 0.0, 1.0)
    moved = F.when(F.col("step") == "raised", threshold + 0.05 * share).when(F.col("step") == "lowered", F.least(F.lit(threshold - 0.01), r * 0.97)).otherwise(r)
    return x.withColumn("calibrated", F.when(s["scale"], F.least(moved, s["cap"])).otherwise(F.col("__v"))).select(*cells.columns, "calibrated", "step", "state")


def diagnose(calibrated: DataFrame, key: str, value: str, cell_area: float, threshold: float = 10.0) -> DataFrame:
    """A row per field of `calibrate`'s cells: ok, issue, quantiles and areas before and after, cells raised, lowered and at the cap."""
    v, s, c, n = F.col(value).cast("double"), F.col("state"), F.col("calibrated"), F.col("n")
    facts = F.struct(*[s[f].alias(f) for f in ("q95", "q99", "top", "cap", "scale", "issue")]).alias("state")
    # equal values are counted first, so that what is sorted for the percentiles is a row a value
    x = calibrated.groupBy(key, facts, "calibrated").agg(F.count("*").alias("n"), F.count_if(F.col("step") == "raised").alias("up"), F.count_if(F.col("step") == "lowered").alias("down"), F.count_if(F.coalesce((v >= threshold) & (v < float("inf")), F.lit(False))).alias("before"))
    after = F.percentile(c, F.array(F.lit(0.95), F.lit(0.99)), n)
    how_many = lambda which: F.sum(F.when(which, n).otherwise(0))
    x = x.groupBy(key, "state").agg(after.alias("q"), F.max(c).alias("top_after"), F.sum("up").alias("n_raised"), F.sum("down").alias("n_lowered"), how_many(s["scale"] & (c >= s["cap"])).alias("n_at_cap"), (F.sum("before") * cell_area).alias("area_before"), (how_many(c >= threshold) * cell_area).alias("area_after"))
    issue = F.concat_ws("; ", s["issue"], F.when(s["scale"] & (F.col("top_after") <= 0), NOW_ZERO))
    before = [s[a].alias(f"{b}_before") for a, b in (("q95", "p95"), ("q99", "p99"), ("top", "top"))]
    return x.select(key, (issue == "").alias("ok"), issue.alias("issue"), *before, F.col("q")[0].alias("p95_after"), F.col("q")[1].alias("p99_after"), "top_after", s["cap"].alias("cap"), "area_before", "area_after", "n_raised", "n_lowered", "n_at_cap")
