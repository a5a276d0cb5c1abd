"""Streams: the accumulation and the motion features over unbounded input. An extension; the batch operators define what comes out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(stream: DataFrame, by: list[str], time: str, value: str, window: str = "1 hour", late: str = "2 hours", hours: float = 0.5) -> DataFrame:
    """(by, start, end, total, peak, n) of tumbling windows; rows later than the watermark are left out, as state must end."""
    x = stream.withWatermark(time, late).groupBy(*by, F.window(time, window).alias("w"))
    return x.agg((F.sum(value) * hours).alias("total"), F.max(value).alias("peak"), F.count("*").alias("n")).select(*by, "w.start", "w.end", "total", "peak", "n")


def motion_stream(stream: DataFrame, key: str, time: str, value: str, late: str = "2 hours") -> DataFrame:
    """(key, time, value, dt_h, rate): each row against the row before of its key, across micro-batches. State: one row a key; it goes
    when nothing came for the watermark's delay."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        x = pd.concat(list(batches)).sort_values([time, value])
        us = x[time].astype("int64") // 1000 if str(x[time].dtype).startswith("datetime64[ns") else x[time].astype("int64")
        before = us.shift(1)
        prior = x[value].shift(1)
        if last is not None:
            before.iloc[0], prior.iloc[0] = last
        dt = (us - before) / 3_600_000_000
        state.update((int(us.iloc[-1]), float(x[value].iloc[-1])))
        if state.getCurrentWatermarkMs() > 0:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(us.iloc[-1] // 1000) + 1))
        yield pd.DataFrame({key: k[0], time: x[time], value: x[value], "dt_h": dt, "rate": ((x[value] - prior) / dt).where(dt > 0)})

    out = f"{key} {kind}, {time} timestamp, {value} double, dt_h double, rate double"
    x = stream.withWatermark(time, late).select(key, time, F.col(value).cast("double").alias(value))
    return x.groupBy(key).applyInPandasWithState(step, out, "us long, value double", "append", "EventTimeTimeout")
