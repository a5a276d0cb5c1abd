"""What-if copies of a track: perturbations, and how their outcomes differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.geo import DEGREE_KM, haversine_km, wrap180
from rainloom.operators import selection
from rainloom.operators.aggregates import against_baseline
from rainloom.operators.timeseries import interpolate, path_length


def envelope(history: DataFrame, strict: Column, relaxed: Sequence[Column], values: Sequence[str], least: int = 30, levels: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Percentiles of the values over the first filter of (strict, *relaxed, all rows) that at least so many rows pass; `level` tells which.
    Rows of all filters are counted in one pass."""
    filters = [F.coalesce(c, F.lit(False)) for c in (strict, *relaxed)] + [F.lit(True)]
    counts = history.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(filters)]).first()  # one row
    chosen = next((i for i, n in enumerate(counts) if n >= least), len(filters) - 1)
    kept = history.where(filters[chosen])
    x = kept.agg(F.count("*").alias("n"))
    for v in values:
        x = x.join(F.broadcast(selection.percentiles(kept, [], v, levels, v)))  # one row each
    return x.select(F.lit(chosen).alias("level"), "n", *[F.col(v)[i].alias(f"{v}_p{round(100 * q)}") for v in values for i, q in enumerate(levels)])


def intensify(df: DataFrame, wind: str, pressure: str, factor: float, cap: float, slope: float, floor: float = 870.0) -> DataFrame:
    """Wind times factor up to the cap; pressure follows along a line of the given (negative) slope, not below the floor."""
    if slope >= 0:
        raise ValueError("pressure must fall as wind rises")
    w, p = F.col(wind), F.col(pressure)
    new = F.when(w.isNotNull(), F.least(w * factor, F.greatest(F.lit(cap), w)))  # least() and greatest() skip nulls
    fallen = p + slope * F.coalesce(new - w, F.lit(0.0))
    return df.withColumns({wind: new, pressure: F.when(p.isNotNull(), F.greatest(fallen, F.least(F.lit(floor), p)))})


def shift_west(df: DataFrame, km: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.withColumn(lon, wrap180(F.col(lon) - km / (DEGREE_KM * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))))


def shift_near_shore(df: DataFrame, by: Sequence[str], hours: str, coast: str, km: float = 75.0, sigma: float = 24.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """A westward shift that peaks where the track is nearest to the coast and fades in time as a bell of sigma hours."""
    centre = F.first(hours).over(Window.partitionBy(*by).orderBy(F.abs(F.col(coast)), hours))
    x = df.withColumn("__h", F.col(hours) - centre)
    w = F.exp(-F.pow(F.col("__h") / sigma, 2) / 2)
    return x.withColumn(lon, wrap180(F.col(lon) - km * w / (DEGREE_KM * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))))).drop("__h")


def stretch(df: DataFrame, by: Sequence[str], order: Sequence[str], time_us: str, values: Sequence[str], gamma: float, step_us: int, lon: str = "lon") -> DataFrame:
    """The same path at 1/gamma of the speed: times are drawn out from the first one, then the series is put on the grid of step_us again."""
    first = F.min(time_us).over(Window.partitionBy(*by))
    x = df.withColumn("__f", first).withColumn(time_us, (F.col("__f") + F.round((F.col(time_us) - F.col("__f")) * gamma)).cast("long")).drop("__f")
    return interpolate(x, by, order, time_us, values, step_us, wrapped=(lon,))


def path_stretch(df: DataFrame, by: Sequence[str], order: Sequence[str], step_m: int, values: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The series by metres along its path, on a grid of step_m."""
    x = path_length(df, by, order, lon, lat).withColumn("path_m", F.round(F.col("path_km") * 1000).cast("long"))
    return interpolate(x, by, order, "path_m", [*values, lat], step_m, wrapped=(lon,))


def scenarios(base: DataFrame, made: Mapping[str, DataFrame]) -> DataFrame:
    """S0 and its variants as one table, by scenario_id; columns that a variant lacks are null."""
    out = base.withColumn("scenario_id", F.lit("S0"))
    for name, df in made.items():
        out = out.unionByName(df.withColumn("scenario_id", F.lit(name)), allowMissingColumns=True)
    return out


def reuse(base: DataFrame, earlier: DataFrame, on: Sequence[str]) -> DataFrame:
    """earlier's rows where it has them, base's where it hasn't."""
    return earlier.unionByName(base.join(earlier.select(*on), list(on), "left_anti"), allowMissingColumns=True)


def compare(metrics: DataFrame, values: Sequence[str], baseline: str = "S0") -> DataFrame:
    """metrics (a row per scenario) with differences to the baseline and the value that moved most, in percent (most_sensitive)."""
    x = against_baseline(metrics, "scenario_id", baseline, values)
    moved = F.array(*[F.struct(F.abs(F.col(f"{v}_pct")).alias("d"), F.lit(v).alias("v")) for v in values])
    top = F.array_max(F.filter(moved, lambda s: s["d"].isNotNull()))
    return x.withColumn("most_sensitive", F.when(F.col("scenario_id") != baseline, top["v"]))


def centroid_shift_km(one: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distance between the centroids (cx, cy in degrees) of two tables of the same keys."""
    b = other.select(*on, F.col("cx").alias("__x"), F.col("cy").alias("__y"))
    return one.join(b, list(on)).withColumn("shift_km", haversine_km(F.col("cx"), F.col("cy"), F.col("__x"), F.col("__y"))).drop("__x", "__y")
