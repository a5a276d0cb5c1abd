"""Half-hourly rain frames: what file names tell, raster bytes, and the cells of rasters."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.functions.clean import rain_value

#: Names of frames: event, start, end, centre, box; numbers as +12.50 or -12.50.
NAME = r"(?P<event>[A-Za-z0-9]+)_(?P<start>\d{14})_(?P<end>\d{14})_c(?P<lon>[-+]?[\d.]+)_(?P<lat>[-+]?[\d.]+)_b(?P<w>[-+]?[\d.]+)_(?P<e>[-+]?[\d.]+)_(?P<s>[-+]?[\d.]+)_(?P<n>[-+]?[\d.]+?)\.tif"


def header(path: Column, pattern: str = NAME) -> dict[str, Column]:
    """Columns from the name of a frame's file; null where it doesn't match."""
    groups = [g.split(">")[0] for g in pattern.split("(?P<")[1:]]
    plain = pattern.replace("?P<", "?<")
    get = {g: F.nullif(F.regexp_extract(path, plain, i + 1), F.lit("")) for i, g in enumerate(groups)}
    number = {"center_lon": "lon", "center_lat": "lat", "bbox_lon_min": "w", "bbox_lon_max": "e", "bbox_lat_min": "s", "bbox_lat_max": "n"}
    return {"gpm_event_uid": get["event"], "time": F.try_to_timestamp(get["start"], F.lit("yyyyMMddHHmmss")), "time_end": F.try_to_timestamp(get["end"], F.lit("yyyyMMddHHmmss")), **{k: get[v].try_cast("double") for k, v in number.items() if v in get}}


# Fixed values of the TIFF format: tag numbers, and struct codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS, COUNTS, PREDICTOR, SAMPLE, SCALE, TIE, NODATA = 256, 257, 258, 259, 273, 278, 279, 317, 339, 33550, 33922, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}


def decode_tiff(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float], float | None]:
    """(band, (lon of the left edge, lat of the top edge, cell width, cell height), nodata) of a one-band striped TIFF, plain or deflated."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        raise ValueError("no TIFF")
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        size = struct.calcsize(TYPES[kind]) * count
        pos = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        tags[tag] = data[pos : pos + count].split(b"\0")[0] if kind == 2 else struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, pos)
    w, h, bits = tags[WIDTH][0], tags[HEIGHT][0], tags[BITS][0]
    how, kind = tags.get(COMPRESSION, (1,))[0], {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE, (1,))[0]]
    if how not in (1, 8, 32946) or tags.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError("unknown compression")
    strips = [data[o : o + n] if how == 1 else zlib.decompress(data[o : o + n]) for o, n in zip(tags[OFFSETS], tags[COUNTS], strict=True)]
    band = np.frombuffer(b"".join(strips), np.dtype(f"{order}{kind}{bits // 8}"))[: w * h].reshape(h, w).astype(float)
    sx, sy = tags.get(SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIE, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    return band, (tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, sy), float(tags[NODATA]) if tags.get(NODATA, b"").strip() else None


def rasters(spark: SparkSession, path: str, pattern: str = NAME, most: float | None = None) -> DataFrame:
    """A row per raster below path: path, header columns, packed values (array of doubles by row, null for missing), n_rows, n_cols, lon0, lat0
    (centre of the first cell), cell_deg, and status (ok or read_error: why). A broken file is a row, not a failure."""
    schema = "path string, values array<double>, n_rows int, n_cols int, lon0 double, lat0 double, cell_deg double, status string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for p, data in zip(x["path"], x["content"], strict=True):
                try:
                    band, (left, top, sx, sy), nodata = decode_tiff(data)
                    gone = ~np.isfinite(band) | np.isclose(band, -9999.0 if nodata is None else nodata)
                    values = [None if g else v for v, g in zip(band.ravel().tolist(), gone.ravel().tolist(), strict=True)]
                    rows.append((p, values, *band.shape, left + sx / 2, top - sy / 2, sx, "ok"))
                except Exception as e:  # the status says what
                    rows.append((p, None, None, None, None, None, None, f"read_error: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"n_rows": "Int32", "n_cols": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path).select("path", "content")
    x = files.mapInPandas(run, schema)
    x = x.withColumn("values", F.transform("values", lambda v: rain_value(v, most=most)))
    return x.withColumns(header(F.element_at(F.split("path", "/"), -1), pattern))


def cells(frames: DataFrame, key: str) -> DataFrame:
    """(key, irow, icol, lon, lat, rain): the cells of packed rasters."""
    x = frames.select(key, "n_cols", "lon0", "lat0", "cell_deg", F.posexplode("values").alias("i", "rain"))
    x = x.withColumns({"irow": F.floor(F.col("i") / F.col("n_cols")).cast("long"), "icol": (F.col("i") % F.col("n_cols")).cast("long")})
    return x.select(key, "irow", "icol", (F.col("lon0") + F.col("icol") * F.col("cell_deg")).alias("lon"), (F.col("lat0") - F.col("irow") * F.col("cell_deg")).alias("lat"), "rain")


def resolved(rows: DataFrame, files: DataFrame, event: str, name: str, given: str | None = None) -> DataFrame:
    """rows with the path under which their raster is listed, and `exists`: the given path, else .../event/name, else .../name."""
    f = files.select("path", F.element_at(F.split("path", "/"), -1).alias("__n"), F.element_at(F.split("path", "/"), -2).alias("__e"))
    best = F.min(F.struct(F.when(F.col("path") == F.col("__given"), 0).when(F.col("__e") == F.col(event), 1).otherwise(2).alias("k"), "path"))
    x = rows.withColumn("__given", F.col(given) if given else F.lit(None).cast("string"))
    hit = x.select(event, name, "__given").distinct().join(f, F.col(name) == F.col("__n")).groupBy(event, name, "__given").agg(best.alias("b")).select(F.col(event).alias("__1"), F.col(name).alias("__2"), F.col("__given").alias("__3"), "b.path")
    same = x[event].eqNullSafe(hit["__1"]) & x[name].eqNullSafe(hit["__2"]) & x["__given"].eqNullSafe(hit["__3"])
    return x.join(hit, same, "left").withColumn("exists", F.col("path").isNotNull()).drop("__given", "__1", "__2", "__3")
