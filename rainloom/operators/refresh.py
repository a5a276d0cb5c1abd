"""Derived columns with their inputs: after a change, those that depend on it are made again, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions import geo
from rainloom.functions.clean import safe_ratio
from rainloom.functions.columns import ContractError
from rainloom.operators import coast, timeseries


@dataclass(frozen=True)
class Derived:
    """Columns that `make` adds to a table, or replaces in it, from its input columns."""

    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    make: Callable[[DataFrame], DataFrame]


class Registry:
    """Derivations, each column by one at most."""

    def __init__(self, rules: Iterable[Derived]) -> None:
        self.rules = list(rules)
        self.by: dict[str, Derived] = {}
        for r in self.rules:
            for c in r.outputs:
                if c in self.by:
                    raise ContractError(f"{c} is derived twice, by {self.by[c].name} and {r.name}")
                self.by[c] = r

    def order(self, changed: Iterable[str]) -> list[Derived]:
        """The derivations that changed columns touch, directly or through others, each behind those that its inputs come from.

        A derivation whose own output was changed by hand isn't made again for that, only where its inputs changed. Cycles among those touched raise."""
        dirty, touched = set(changed), []
        while new := [r for r in self.rules if r not in touched and dirty & set(r.inputs)]:
            touched += new
            dirty.update(c for r in new for c in r.outputs)
        out: list[Derived] = []
        while left := [r for r in self.rules if r in touched and r not in out]:
            ready = [r for r in left if not any(self.by.get(c) in left and self.by[c] is not r for c in r.inputs) and not set(r.inputs) & set(r.outputs)]
            if not ready:
                raise ContractError(f"derivations depend on each other: {', '.join(r.name for r in left)}")
            out += ready
        return out

    def refresh(self, df: DataFrame, changed: Iterable[str]) -> DataFrame:
        """df with everything made again that depends on the changed columns; all other columns stay as they are, also derived ones."""
        columns = list(df.columns)
        for r in self.order(changed):
            if missing := [c for c in r.inputs if c not in df.columns]:
                raise ContractError(f"{r.name} lacks {', '.join(missing)}")
            df = r.make(df)
            columns += [c for c in r.outputs if c not in columns]
        return df.select(columns)


def track_features(by: Sequence[str], order: Sequence[str], shore: DataFrame, reach_km: float, scale: DataFrame, kernel_km: float = 300.0) -> Registry:
    """What a track of by, time, lon, lat, wind and pressure is described by. order: columns that order a track. shore: segments of the coast, met within reach_km.
    scale: one row of wind_mean, wind_std, deficit_mean and deficit_std, of the baseline: an index of changed rows is on the baseline's scale."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1

    def motion(df: DataFrame) -> DataFrame:
        hours = (timeseries.micros(F.col("time")) - F.lag(timeseries.micros(F.col("time"))).over(w)) / timeseries.HOUR_US
        before = F.lag("lon").over(w), F.lag("lat").over(w)
        df = df.withColumns({"dt_h": hours, "step_km": geo.haversine_km(*before, F.col("lon"), F.col("lat")), "move_dir": geo.bearing_deg(*before, F.col("lon"), F.col("lat"))})
        moved = F.col("dt_h") > 0
        df = df.withColumns({"step_km": F.when(moved, F.col("step_km")), "move_dir": F.when(moved, F.col("move_dir")), "move_speed": F.when(moved, F.col("step_km") / F.col("dt_h"))})
        return df.withColumns({c: F.when(first, F.lead(c).over(w)).otherwise(F.col(c)) for c in ("dt_h", "step_km", "move_speed", "move_dir")})

    def heading(df: DataFrame) -> DataFrame:
        return df.withColumns({"move_sin": F.sin(F.radians("move_dir")), "move_cos": F.cos(F.radians("move_dir"))})

    def rates(df: DataFrame) -> DataFrame:
        return timeseries.motion(df.withColumn("__dt", F.col("dt_h")), by, order, "time", ["wind", "pressure"], edge="next").withColumn("dt_h", F.col("__dt")).drop("__dt")

    def flags(df: DataFrame) -> DataFrame:
        up, down = F.col("wind_rate"), F.col("pressure_rate")
        return df.withColumns({"intensifying": F.coalesce((up > 0) & (down <= 0), F.lit(False)), "weakening": F.coalesce((up < 0) & (down >= 0), F.lit(False))})

    def clock(df: DataFrame) -> DataFrame:
        (hs, hc), (ms, mc) = geo.cyclic(F.hour("time"), 24), geo.cyclic(F.month("time"), 12)
        return df.withColumns({"hour_sin": hs, "hour_cos": hc, "month_sin": ms, "month_cos": mc, "season": geo.season(F.month("time"))})

    def shores(df: DataFrame) -> DataFrame:
        df = df.drop("on_land", "coast_km")
        return coast.coast_distance(coast.on_land(df, shore), shore, None, reach_km)

    def near(df: DataFrame) -> DataFrame:
        return df.withColumn("coast_near", F.coalesce(geo.coast_kernel(F.col("coast_km"), kernel_km), F.lit(0.0)))

    def intensity(df: DataFrame) -> DataFrame:
        z = lambda v, k: safe_ratio(v - F.col(f"{k}_mean"), F.col(f"{k}_std"))
        x = df.join(F.broadcast(scale))  # one row
        return x.withColumn("intensity_index", 0.5 * z(F.col("wind"), "wind") + 0.5 * z(1010 - F.col("pressure"), "deficit")).drop(*scale.columns)

    return Registry(
        [
            Derived("motion", (*by, "time", "lon", "lat"), ("dt_h", "step_km", "move_speed", "move_dir"), motion),
            Derived("heading", ("move_dir",), ("move_sin", "move_cos"), heading),
            Derived("rates", (*by, "time", "wind", "pressure"), ("wind_rate", "pressure_rate"), rates),
            Derived("flags", ("wind_rate", "pressure_rate"), ("intensifying", "weakening"), flags),
            Derived("clock", ("time",), ("hour_sin", "hour_cos", "month_sin", "month_cos", "season"), clock),
            Derived("shores", ("lon", "lat"), ("on_land", "coast_km"), shores),
            Derived("near", ("coast_km",), ("coast_near",), near),
            Derived("intensity", ("wind", "pressure"), ("intensity_index",), intensity),
            Derived("life", (*by, "time"), ("life_progress",), lambda df: timeseries.life_progress(df, by, order)),
        ]
    )


def baseline_scale(df: DataFrame) -> DataFrame:
    """The one row that track_features takes as scale."""
    deficit = 1010 - F.col("pressure")
    return df.agg(F.avg("wind").alias("wind_mean"), F.stddev_samp("wind").alias("wind_std"), F.avg(deficit).alias("deficit_mean"), F.stddev_samp(deficit).alias("deficit_std"))
