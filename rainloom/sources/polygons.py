"""Polygons and lines from binary shape files: records with rings and holes as vertices, one row each."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: file code, version, bytes of the file's header, and the types that hold parts of points.
FILE_CODE, VERSION, HEADER = 9994, 1000, 100
LINE, POLYGON = 3, 5
#: Types with heights or measures behind the points are read as their flat ones.
FLAT = {3: LINE, 13: LINE, 23: LINE, 5: POLYGON, 15: POLYGON, 25: POLYGON}

SCHEMA = "path string, record int, part int, i int, x double, y double, kind string, error string"


def ring_area(x: np.ndarray, y: np.ndarray) -> float:
    """Twice the signed area of a closed ring: negative where it runs clockwise, as outer rings do."""
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def _records(data: bytes) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(record number, flat type, parts as arrays of points) of a file's records with points; null shapes and other types are passed over."""
    if len(data) < HEADER or struct.unpack(">i", data[:4])[0] != FILE_CODE:
        raise ValueError("no shape file")
    at = HEADER
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">2i", data, at)
        body, at = at + 8, at + 8 + 2 * words
        if at > len(data) or words < 2:
            raise ValueError(f"record {number} is cut off")
        kind = FLAT.get(struct.unpack_from("<i", data, body)[0])
        if kind is None:
            continue
        n_parts, n_points = struct.unpack_from("<2i", data, body + 36)
        if n_parts < 0 or n_points < 0 or body + 44 + 4 * n_parts + 16 * n_points > at:
            raise ValueError(f"record {number} is cut off")
        starts = np.frombuffer(data, "<i4", n_parts, body + 44)
        points = np.frombuffer(data, "<f8", 2 * n_points, body + 44 + 4 * n_parts).reshape(-1, 2)
        yield number, kind, np.split(points, starts[1:])


def _frames(path: str, data: bytes, most: int = 1 << 16) -> Iterator[pd.DataFrame]:
    """The vertices of a file, about `most` a frame (whole parts): a frame a part would cost more than its points."""
    held, n = [], 0

    def frame() -> pd.DataFrame:
        sizes = [len(p) for *_, p in held]
        column = lambda k: np.repeat([h[k] for h in held], sizes)
        points = np.concatenate([p for *_, p in held])
        return pd.DataFrame({"path": path, "record": column(0), "part": column(1), "i": np.concatenate([np.arange(k) for k in sizes]), "x": points[:, 0], "y": points[:, 1], "kind": column(2), "error": None})

    error = None
    try:
        for number, kind, parts in _records(data):
            for j, points in enumerate(parts):
                closed = kind == POLYGON and len(points) > 1 and (points[0] == points[-1]).all()
                p = points[:-1] if closed else points
                held.append((number, j, "line" if kind == LINE else "hole" if ring_area(p[:, 0], p[:, 1]) > 0 else "outer", p))
                n += len(p)
            if n >= most:
                yield frame()
                held, n = [], 0
    except (ValueError, struct.error) as e:
        error = str(e)
    if n:
        yield frame()
    if error is not None:
        yield pd.DataFrame([(path, None, None, None, None, None, None, error)], columns=["path", "record", "part", "i", "x", "y", "kind", "error"])


def parse_shapes(files: DataFrame) -> DataFrame:
    """path, record, part, i, x, y, kind (outer, hole or line), error: a row per vertex of the shape files (path, content).

    Rings are without the repeated last point. A file is one task's work; one that is no shape file or is cut off gives what stands before the damage and
    a row with the error. Records without points (null shapes) give no rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for name, data in zip(x["path"], x["content"], strict=True):
                for frame in _frames(name, bytes(data)):
                    yield frame.astype({"record": "Int32", "part": "Int32", "i": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_shapes(spark: SparkSession, path: str, pattern: str = "*.shp") -> DataFrame:
    """parse_shapes of every file below path."""
    return parse_shapes(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def shape_bytes(records: Iterable[list[list[tuple[float, float]]] | None], kind: int = POLYGON) -> bytes:
    """A shape file of records, each a list of parts (None: a null shape). Polygons' rings are closed; outer ones should run clockwise."""
    body, box = b"", np.zeros(4)
    for number, parts in enumerate(records, 1):
        if parts is None:
            content = struct.pack("<i", 0)
        else:
            arrays = [np.array([*p, p[0]] if kind == POLYGON else p, float).reshape(-1, 2) for p in parts]
            points = np.concatenate(arrays)
            box = np.array([*points.min(0), *points.max(0)])
            starts = np.cumsum([0, *map(len, arrays)])[:-1]
            content = struct.pack("<i4d2i", kind, *box, len(arrays), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
        body += struct.pack(">2i", number, len(content) // 2) + content
    return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, (HEADER + len(body)) // 2) + struct.pack("<2i4d4d", VERSION, kind, *box, 0, 0, 0, 0) + body
