"""Best-track text files: a header line (66666 ...) names the storm that the rows below it belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.functions.clean import uid
from rainloom.functions.geo import bearing_deg, haversine_km, wrap180
from rainloom.operators.timeseries import motion


def scan(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(points, rejects). A header goes down its file by a window over the headers' line numbers: headers are numbered within the
    file, and each row takes the number of headers above it, so only headers are joined. rejects: file, line, text, reason."""
    lines = spark.read.text(paths).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("text")).where("text <> ''")
    is_header = F.col("text").startswith("66666")
    part = F.split("text", r"\s+")
    x = lines.withColumns({"p": part, "is_header": is_header})
    # lines of one file keep their order in the ids; a file is one series
    w = Window.partitionBy("source_file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = lambda i: F.get("p", F.lit(i))
    head = F.when(F.col("is_header"), F.struct(p(1).alias("typhoon_id"), p(2).try_cast("int").alias("record_count"), p(3).alias("storm_seq"), p(4).alias("typhoon_code"), p(7).alias("typhoon_name")))
    x = x.withColumn("h", F.last(head, ignorenulls=True).over(w)).where("not is_header")
    time = F.try_to_timestamp(p(0), F.lit("yyyyMMddHH"))
    number = {"intensity": p(1), "lat10": p(2), "lon10": p(3), "pressure": p(4), "wind": p(5)}
    x = x.withColumns({"time": F.when(F.length(p(0)) == 10, time), **{k: c.try_cast("int") for k, c in number.items()}})
    bad = F.when(F.col("h").isNull(), "no header").when(F.size("p") < 6, "short row").when(F.col("time").isNull(), "bad time")
    for k in number:
        bad = bad.when(F.col(k).isNull(), f"bad {k}")
    x = x.withColumn("reason", bad)
    points = x.where("reason is null").select(
        uid(F.regexp_replace("source_file", r"\.[^.]*$", ""), F.coalesce("h.storm_seq", F.lit("0"))).alias("event_uid"),
        "source_file", "h.typhoon_id", "h.storm_seq", "h.typhoon_code", "h.record_count", "h.typhoon_name", "time", "intensity",
        (F.col("lat10") / 10).alias("lat"), (F.col("lon10") / 10).alias("lon"), wrap180(F.col("lon10") / 10).alias("lon_180"), F.col("pressure").cast("double").alias("pressure"), F.col("wind").cast("double").alias("wind"),
    )
    return points, x.where("reason is not null").select("source_file", "line", "text", "reason")


def with_motion(points: DataFrame, edge: str = "null") -> DataFrame:
    """Points with dt_h, distance, speed and direction of the last step, and rates of wind and pressure."""
    w = Window.partitionBy("event_uid").orderBy("time")
    before: list[Column] = [F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")]
    x = motion(points, ["event_uid"], ["time"], "time", ["wind", "pressure"], edge)
    x = x.withColumns({"move_distance_km": haversine_km(*before), "move_dir_deg": bearing_deg(*before)})
    x = x.withColumn("move_speed_kmh", F.when(F.col("dt_h") > 0, F.col("move_distance_km") / F.col("dt_h")))
    return x.withColumnsRenamed({"wind_rate": "wind_change_rate", "pressure_rate": "pressure_change_rate"})
