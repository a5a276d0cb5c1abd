"""Operators on series of rows that belong to one key and are ordered in time.

`by` names the key, `order` the columns of the order; give enough of them to make it total. All windows are partitioned by the key,
so a series is one task's at most; global statistics come from aggregates that are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.clean import safe_ratio
from rainloom.functions.geo import haversine_km, wrap180
from rainloom.operators import selection

HOUR_US = 3_600_000_000


def micros(time: Column) -> Column:
    """Microseconds since the epoch, of zoned and plain timestamps."""
    return F.unix_micros(time.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def series(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def motion(df: DataFrame, by: Sequence[str], order: Sequence[str], time: str, values: Sequence[str], edge: str = "null") -> DataFrame:
    """dt_h and, for each value, <value>_rate per hour against the row before; no rate where time stands still.

    edge: what the first row of a series gets: "null", or "next" for the second row's rate."""
    w = series(by, order)
    us = micros(F.col(time))
    df = df.withColumn("dt_h", (us - F.lag(us).over(w)) / HOUR_US)
    rate = lambda v: F.when(F.col("dt_h") > 0, (F.col(v) - F.lag(v).over(w)) / F.col("dt_h"))
    df = df.withColumns({f"{v}_rate": rate(v) for v in values})
    if edge == "next":
        first = F.row_number().over(w) == 1
        df = df.withColumns({f"{v}_rate": F.when(first, F.lead(f"{v}_rate").over(w)).otherwise(F.col(f"{v}_rate")) for v in values})
    return df


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """<value>_cumsum and <value>_cummax."""
    w = series(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{value}_cumsum": F.sum(value).over(w), f"{value}_cummax": F.max(value).over(w)})


def life_progress(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0 for the first row of a series, 1 for the last; 0 for a single row."""
    w = series(by, order)
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("life_progress", F.coalesce(safe_ratio((F.row_number().over(w) - 1).cast("double"), (n - 1).cast("double")), F.lit(0.0)))


def jumps(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """A row per series: n_steps, p95 and largest absolute step, and n_jumps beyond both 2.5 times p95 and mean + 4 standard deviations."""
    w = series(by, order)
    steps = df.withColumn("step", F.abs(F.col(value) - F.lag(value).over(w))).where("step is not null").select(*by, "step")
    stats = steps.groupBy(*by).agg(F.count("*").alias("n_steps"), F.percentile("step", F.lit(0.95)).alias("p95_step"), F.max("step").alias("max_step"), F.avg("step").alias("m"), F.stddev_samp("step").alias("s"))
    limit = F.greatest(2.5 * F.col("p95_step"), F.col("m") + 4 * F.coalesce("s", F.lit(0.0)))
    return steps.join(stats.withColumn("limit", limit), list(by)).groupBy(*by, "n_steps", "p95_step", "max_step").agg(F.count_if(F.col("step") > F.col("limit")).alias("n_jumps"))


def sessions(df: DataFrame, by: Sequence[str], order: Sequence[str], gap: Column) -> DataFrame:
    """session: 0, 1, ... within a series; a row begins a new one where gap holds. gap may use lag over the same order."""
    w = series(by, order)
    starts = df.withColumn("session", F.coalesce(gap, F.lit(False)).cast("long"))
    return starts.withColumn("session", F.sum("session").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def fill_by_position(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """value with gaps filled linearly by row number, and ends by the nearest known value."""
    w = series(by, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("__n", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(value).alias("v")))
    df = df.withColumns({"__a": F.last(known, ignorenulls=True).over(back), "__b": F.first(known, ignorenulls=True).over(ahead)})
    between = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("__n") - F.col("__a.n")) / (F.col("__b.n") - F.col("__a.n"))
    filled = F.coalesce(F.col(value), F.when(F.col("__a").isNull(), F.col("__b.v")).when(F.col("__b").isNull(), F.col("__a.v")).otherwise(between))
    return df.withColumn(value, filled).drop("__n", "__a", "__b")


def fill_by_median(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Gaps take the median of their group, else of the whole table, else 0."""
    group = df.groupBy(*by).agg(*[F.percentile(v, F.lit(0.5)).alias(f"__g_{v}") for v in values])
    wholes = {v: selection.percentiles(df, [], v, (0.5,)).select(F.col("q")[0].alias(f"__w_{v}")) for v in values}
    df = df.join(group, list(by), "left")
    for whole in wholes.values():
        df = df.join(F.broadcast(whole))  # one row
    return df.withColumns({v: F.coalesce(F.col(v), F.col(f"__g_{v}"), F.col(f"__w_{v}"), F.lit(0.0)) for v in values}).drop(*[f"__{k}_{v}" for k in "gw" for v in values])


def path_length(df: DataFrame, by: Sequence[str], order: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """path_km: great-circle length of the track up to each row."""
    w = series(by, order)
    step = haversine_km(F.lag(lon).over(w), F.lag(lat).over(w), F.col(lon), F.col(lat))
    df = df.withColumn("__step", F.coalesce(step, F.lit(0.0)))
    return df.withColumn("path_km", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__step")


def cadence(df: DataFrame, by: Sequence[str], order: Sequence[str], time: str, minutes: int) -> DataFrame:
    """A row per series: n, is_monotone (times strictly rise), on_cadence (every step is so many minutes)."""
    w = series(by, order)
    us = micros(F.col(time))
    steps = df.withColumn("__d", us - F.lag(us).over(w))
    ok = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return steps.groupBy(*by).agg(F.count("*").alias("n"), ok(F.col("__d") > 0).alias("is_monotone"), ok(F.col("__d") == minutes * 60_000_000).alias("on_cadence"))


def interpolate(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, values: Sequence[str], step: int, wrapped: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Values on the grid x = k * step (whole numbers) within each series, linear between neighbours.

    Each row makes the grid points up to the next row, so nothing is joined. wrapped values are longitudes: they take the short way round.
    keep: columns that grid points copy from the row before them. Rows that repeat an x keep the last."""
    w = series(by, [x])
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by, x).orderBy(*[F.col(c).desc() for c in order]))).where("__r = 1").drop("__r")
    df = df.withColumns({"__x1": F.lead(x).over(w), **{f"__n_{v}": F.lead(v).over(w) for v in (*values, *wrapped)}})
    first, last = F.ceil(F.col(x) / step).cast("long"), F.ceil(F.col("__x1") / step).cast("long") - 1
    own = F.when(F.col(x) % step == 0, F.array((F.col(x) / step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    points = F.when(F.col("__x1").isNull(), own).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__k", F.explode(points)).withColumn("__at", F.col("__k") * step)
    share = F.coalesce((F.col("__at") - F.col(x)) / (F.col("__x1") - F.col(x)), F.lit(0.0))
    out = {v: F.when(share == 0, F.col(v)).otherwise(F.col(v) + (F.col(f"__n_{v}") - F.col(v)) * share) for v in values}
    out |= {v: F.when(share == 0, wrap180(F.col(v))).otherwise(wrap180(F.col(v) + wrap180(F.col(f"__n_{v}") - F.col(v)) * share)) for v in wrapped}
    return df.select(*by, F.col("__at").alias(x), *[c.alias(v) for v, c in out.items()], *keep)


def at_times(points: DataFrame, track: DataFrame, by: Sequence[str], x: str, values: Sequence[str], wrapped: Sequence[str] = ()) -> DataFrame:
    """points with the values of track at their x: linear between neighbours, constant beyond the ends, and `outside` telling so.

    Both tables become one series, in which each point sees the last track row before and the first behind it."""
    kept = [c for c in points.columns if c not in by and c != x]
    row = F.struct(F.col(x).alias("x"), *[F.col(v) for v in (*values, *wrapped)])
    a = track.select(*by, x, row.alias("__t"), F.lit(0).alias("__p"))
    b = points.select(*by, x, *kept, F.lit(1).alias("__p"))
    w = Window.partitionBy(*by).orderBy(x, "__p")
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("__a", F.last("__t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    behind = Window.partitionBy(*by).orderBy(F.col(x).desc(), "__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__b", F.last("__t", ignorenulls=True).over(behind)).where("__p = 1")
    share = (F.col(x) - F.col("__a.x")) / F.nullif(F.col("__b.x") - F.col("__a.x"), F.lit(0))
    mid = lambda v: F.coalesce(F.col(f"__a.{v}") + (F.col(f"__b.{v}") - F.col(f"__a.{v}")) * share, F.col(f"__a.{v}"), F.col(f"__b.{v}"))
    lon = lambda v: wrap180(F.coalesce(F.col(f"__a.{v}") + wrap180(F.col(f"__b.{v}") - F.col(f"__a.{v}")) * share, F.col(f"__a.{v}"), F.col(f"__b.{v}")))
    outside = F.col("__a").isNull() | F.col("__b").isNull()
    return both.select(*by, x, *kept, *[mid(v).alias(v) for v in values], *[lon(v).alias(v) for v in wrapped], outside.alias("outside"))


def snapshots(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Three rows of a series, as `snapshot`: the peak of value, the middle of what lies before it, and of what lies behind it."""
    w = series(by, order)
    df = df.withColumns({"__n": F.row_number().over(w), "__size": F.count("*").over(Window.partitionBy(*by))})
    peak = F.first("__n").over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), "__n"))
    df = df.withColumn("__peak", peak)
    early, late = F.floor((F.col("__peak") + 1) / 2), F.ceil((F.col("__peak") + F.col("__size")) / 2)
    kind = F.when(F.col("__n") == F.col("__peak"), "peak").when(F.col("__n") == early, "early").when(F.col("__n") == late, "weakening")
    return df.withColumn("snapshot", kind).where("snapshot is not null").drop("__n", "__size", "__peak")
