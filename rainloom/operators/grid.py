"""Fields on grids in long form (a row per cell): resampling, fusion, projection back, accumulation, neighbourhood scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.functions.geo import from_storm_axes, local_km, to_storm_axes


def relative_grid(spark: SparkSession, half_km: float = 1000.0, step_km: float = 10.0) -> DataFrame:
    """(iy, ix, ahead, left): a square grid about the storm."""
    n = round(2 * half_km / step_km) + 1
    return spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("iy"), (F.col("id") % n).cast("int").alias("ix")).withColumns({"ahead": F.col("ix") * step_km - half_km, "left": half_km - F.col("iy") * step_km})


def geographic_grid(tracks: DataFrame, by: Sequence[str], degrees: float = 0.1, margin: float = 8.0) -> DataFrame:
    """(by, ilat, ilon): cells of a regular grid over each track's bounding box and a margin."""
    lo = lambda c: F.floor((F.min(c) - margin) / degrees).cast("long")
    hi = lambda c: F.ceil((F.max(c) + margin) / degrees).cast("long")
    box = tracks.groupBy(*by).agg(lo("lat").alias("a"), hi("lat").alias("b"), lo("lon").alias("c"), hi("lon").alias("d"))
    return box.withColumn("ilat", F.explode(F.sequence("a", "b"))).withColumn("ilon", F.explode(F.sequence("c", "d"))).select(*by, "ilat", "ilon")


def bilinear(points: DataFrame, cells: DataFrame, on: Sequence[str], row: str, col: str, value: str, outside: float | None = None) -> DataFrame:
    """points with value at fractional (row, col), from the four cells (irow, icol, value) around.

    Each point asks for its four corners, an equi-join, and the answers are summed by point; a corner that is missing or null makes the
    point `outside`. Corners of no weight aren't asked for. points must have a column __id that identifies them."""
    r0, c0 = F.floor(row).cast("long"), F.floor(col).cast("long")
    fr, fc = F.col(row) - r0, F.col(col) - c0
    corner = lambda dr, dc, w: F.struct((r0 + dr).alias("irow"), (c0 + dc).alias("icol"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc))
    asked = points.select("__id", *on, F.explode(F.filter(four, lambda s: s["w"] > 0)).alias("q")).select("__id", *on, "q.*")
    got = asked.join(cells.select(*on, "irow", "icol", F.col(value).alias("__v")), [*on, "irow", "icol"], "left")
    ok = F.count("__v") == F.count("*")
    sums = got.groupBy("__id").agg(F.when(ok, F.sum(F.col("w") * F.col("__v"))).alias(value))
    return points.join(sums, "__id", "left").withColumn(value, F.coalesce(value, F.lit(outside).cast("double")))


def bilinear_packed(points: DataFrame, frames: DataFrame, on: Sequence[str], row: str, col: str, field: str, n_rows: int, n_cols: int, value: str, outside: float | None = None) -> DataFrame:
    """points with value at fractional (row, col) of their frame's raster, an array of n_rows * n_cols cells row by row: as `bilinear`, with one join by frame and
    the four corners taken by index. frames: on, field; a row a frame, so no cell is shuffled by itself and no point is."""
    r0, c0 = F.floor(row).cast("int"), F.floor(col).cast("int")
    fr, fc = F.col(row) - r0, F.col(col) - c0
    x = points.join(frames.select(*on, F.col(field).alias("__field")), list(on), "left")
    total, ok = F.lit(0.0), F.col(row).isNotNull() & F.col(col).isNotNull()
    for dr, dc, w in ((0, 0, (1 - fr) * (1 - fc)), (0, 1, (1 - fr) * fc), (1, 0, fr * (1 - fc)), (1, 1, fr * fc)):
        r, c = r0 + dr, c0 + dc
        cell = F.when((r >= 0) & (r < n_rows) & (c >= 0) & (c < n_cols), F.get("__field", r * n_cols + c))
        total, ok = total + F.when(w > 0, w * cell).otherwise(0.0), ok & ((w <= 0) | cell.isNotNull())
    return x.withColumn(value, F.coalesce(F.when(ok, total), F.lit(outside).cast("double"))).drop("__field")


def to_relative(frames: DataFrame, cells: DataFrame, grid: DataFrame, key: str, value: str, most_missing: float = 0.5) -> DataFrame:
    """(key, iy, ix, value): each frame's raster resampled to the storm's own axes; frames of which more than most_missing lies outside are left out.

    frames: key, lon, lat, heading, lon0, lat0, cell_deg (centre of the raster's first cell and its cell size); cells: key, irow, icol, value.
    The grid is small and fixed; it goes to every task."""
    x = frames.join(F.broadcast(grid))
    east, north = from_storm_axes(F.col("ahead"), F.col("left"), F.col("heading"))
    lon = F.col("lon") + east / (111.32 * F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    lat = F.col("lat") + north / 111.32
    x = x.withColumns({"__row": (F.col("lat0") - lat) / F.col("cell_deg"), "__col": (lon - F.col("lon0")) / F.col("cell_deg")})
    x = x.withColumn("__id", F.struct(key, "iy", "ix")).select("__id", key, "iy", "ix", "__row", "__col")
    out = bilinear(x, cells, [key], "__row", "__col", value).select(key, "iy", "ix", value)
    missing = out.groupBy(key).agg(F.avg(F.col(value).isNull().cast("int")).alias("nan_ratio")).where(F.col("nan_ratio") <= most_missing)
    return out.join(missing, key)


def fuse(edges: DataFrame, fields: DataFrame, value: str, how: str = "log") -> DataFrame:
    """(target_id, iy, ix, value): the weighted mean of the retrieved templates by cell, over those that have the cell; in logs, as rain is skewed.

    edges: target_id, history_id, similarity_weight; fields: history_id, iy, ix, value."""
    v = F.log1p(F.greatest(F.col(value), F.lit(0.0))) if how == "log" else F.col(value)
    x = edges.join(fields.where(F.col(value).isNotNull()), "history_id").groupBy("target_id", "iy", "ix")
    mean = F.sum(F.col("similarity_weight") * v) / F.sum("similarity_weight")
    return x.agg((F.expm1(mean) if how == "log" else mean).alias(value), F.count("*").alias("n_templates"))


def project_back(track: DataFrame, cells: DataFrame, fields: DataFrame, by: Sequence[str], key: str, value: str, half_km: float = 1000.0, step_km: float = 10.0, degrees: float = 0.1, packed: bool = False) -> DataFrame:
    """(by, key, ilat, ilon, value): each frame's storm-relative field on the geographic cells it can reach; 0 where it doesn't.

    track: by, key, lon, lat, heading. cells: by, ilat, ilon. fields: key, iy, ix, value; or, packed, key and value as the array of all cells row by row."""
    x = track.join(cells, list(by))
    east, north = local_km(F.col("ilon") * degrees, F.col("ilat") * degrees, F.col("lon"), F.col("lat"))
    ahead, left = to_storm_axes(east, north, F.col("heading"))
    x = x.withColumns({"__row": (half_km - left) / step_km, "__col": (ahead + half_km) / step_km}).where((F.abs(ahead) <= half_km) & (F.abs(left) <= half_km))
    if packed:
        n = round(2 * half_km / step_km) + 1
        points = x.select(*by, key, "ilat", "ilon", "__row", "__col")
        return bilinear_packed(points, fields, [key], "__row", "__col", value, n, n, value, outside=0.0).select(*by, key, "ilat", "ilon", value)
    x = x.withColumn("__id", F.struct(key, "ilat", "ilon"))
    return bilinear(x.select("__id", *by, key, "ilat", "ilon", "__row", "__col"), fields.withColumnsRenamed({"iy": "irow", "ix": "icol"}), [key], "__row", "__col", value, outside=0.0).select(*by, key, "ilat", "ilon", value)


def accumulate(cells: DataFrame, by: Sequence[str], value: str, time: str, hours: float = 0.5, thresholds: Sequence[float] = (10, 20)) -> DataFrame:
    """By cell: total (sum of rate * hours), the largest rate and its first time, hours at or above each threshold. One shuffle, summed before it."""
    return cells.groupBy(*by).agg(
        F.sum(F.col(value) * hours).alias("total"),
        F.max(value).alias("peak"),
        F.min_by(time, F.struct((-F.col(value)).alias("v"), time)).alias("peak_time"),
        *[F.sum(F.when(F.col(value) >= t, hours).otherwise(0.0)).alias(f"hours_{t:g}") for t in thresholds],
    )


def box_sums(cells: DataFrame, by: Sequence[str], row: str, col: str, value: str, size: int) -> DataFrame:
    """value as its mean over a size x size box with zeros beyond the edges: sums along rows, then along columns."""
    k = size // 2
    x = cells.withColumn("__s", F.sum(value).over(Window.partitionBy(*by, row).orderBy(col).rangeBetween(-k, k)))
    return x.withColumn(value, F.sum("__s").over(Window.partitionBy(*by, col).orderBy(row).rangeBetween(-k, k)) / float(size * size)).drop("__s")


def fractions_skill(cells: DataFrame, by: Sequence[str], row: str, col: str, predicted: Column, observed: Column, sizes: Sequence[int] = (3, 5, 9)) -> DataFrame:
    """(by, size, fss): 1 - mean squared difference of the fractions over the mean of their squares; null where both are empty. cells must be a full grid."""
    out = None
    base = cells.withColumns({"__p": predicted.cast("int").cast("double"), "__o": observed.cast("int").cast("double")})
    for size in sizes:
        x = box_sums(box_sums(base, by, row, col, "__p", size), by, row, col, "__o", size)
        d = F.sum(F.pow(F.col("__p") - F.col("__o"), 2))
        ref = F.sum(F.col("__p") * F.col("__p") + F.col("__o") * F.col("__o"))
        one = x.groupBy(*by).agg(F.when(ref > 0, 1 - d / ref).alias("fss")).withColumn("size", F.lit(size))
        out = one if out is None else out.unionByName(one)
    return out.select(*by, "size", "fss")


def duration_area(cells: DataFrame, by: Sequence[str], predicted: str, observed: str, area: Column, hours: float = 0.5, thresholds: Sequence[float] = (1, 5, 10)) -> DataFrame:
    """(by, threshold): area times hours at or above each threshold in both fields, their difference, and that in percent of the observed (null without any). One shuffle, summed before it."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    x = cells.select(*by, F.col(predicted).alias("__p"), F.col(observed).alias("__o"), (area * hours).alias("__w"), each.alias("threshold"))
    total = lambda c: F.sum(F.when(F.col(c) >= F.col("threshold"), F.col("__w")).otherwise(0.0))
    x = x.groupBy(*by, "threshold").agg(total("__p").alias("predicted_km2h"), total("__o").alias("observed_km2h"))
    error = F.col("predicted_km2h") - F.col("observed_km2h")
    return x.withColumns({"error_km2h": error, "error_pct": 100 * error / F.nullif("observed_km2h", F.lit(0.0))})


def key_locations(cells: DataFrame, by: Sequence[str], at: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, kind, at, value): for each of the columns `values` the cell where it is largest, the smallest place on ties. One shuffle, summed before it."""
    best = [F.min(F.struct((-F.col(v)).alias("neg"), *at)).alias(v) for v in values]
    x = cells.groupBy(*by).agg(*best)
    each = F.array(*[F.struct(F.lit(v).alias("kind"), *[F.col(v)[a].alias(a) for a in at], (-F.col(v)["neg"]).alias("value")) for v in values])
    return x.select(*by, F.explode(each).alias("__each")).select(*by, "__each.*")
