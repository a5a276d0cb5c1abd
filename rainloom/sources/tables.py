"""CSV, packed arrays and reports: what scripts exchange, as Spark tables."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.functions.clean import all_finite
from rainloom.functions.columns import ContractError, require

BOM = "﻿"


def read_csv(spark: SparkSession, path: str | Sequence[str], ids: Sequence[str] = (), times: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header, possibly behind a byte order mark. All columns are read as text; numbers are cast where every value is one, ids stay text with
    their leading zeros, times are parsed where they can be. columns: those alone."""
    raw = spark.read.option("header", True).option("multiLine", False).csv(list(path) if not isinstance(path, str) else path)
    raw = raw.withColumnsRenamed({c: c.removeprefix(BOM).strip() for c in raw.columns})
    raw = require(raw, columns, "the CSV").select(*columns) if columns else raw
    plain = [c for c in raw.columns if c not in {*ids, *times}]
    bad = raw.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in plain]).first().asDict() if plain else {}
    out = {c: F.col(c).try_cast("double") for c in plain if not bad[c]} | {c: F.try_to_timestamp(F.col(c)) for c in times}
    return all_finite(raw.withColumns(out)) if out else raw


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV; one line is read."""
    first = spark.read.text(path).first()
    return [c.strip().strip('"') for c in first.value.removeprefix(BOM).split(",")] if first else []


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """One CSV folder with a header; the byte order mark goes before the first name."""
    df.withColumnsRenamed({df.columns[0]: BOM + df.columns[0]} if bom else {}).write.mode("overwrite").option("header", True).csv(path)


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists, by the file systems that Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    raise ContractError(f"none of {', '.join(candidates)} exists")


def read_npz(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A row per array of NPZ files: path, name, shape, values (flat, NaN as null). A file that lacks a required array fails with its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for p, data in zip(x["path"], x["content"], strict=True):
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    if gone := [r for r in required if r not in z.files]:
                        raise ContractError(f"{p} lacks {', '.join(gone)}")
                    rows = [(p, n, list(z[n].shape), [None if v != v else v for v in z[n].ravel().astype(float).tolist()]) for n in z.files if z[n].dtype.kind in "biuf"]
                yield pd.DataFrame(rows, columns=["path", "name", "shape", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, shape array<long>, values array<double>")


def write_packed(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Packed fields as Parquet: arrays of floats beside their keys."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def report(df: DataFrame, title: str, limit: int = 100) -> tuple[str, str]:
    """(markdown, json) of a small result: the rows of a report, at most `limit`."""
    rows = [r.asDict() for r in df.limit(limit).collect()]
    text = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(text(r[c]) for c in df.columns) + " |" for r in rows]]
    return "\n".join(lines) + "\n", json.dumps(rows, default=str, ensure_ascii=False)


def run_log(spark: SparkSession, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """(step, issue, status) of a run: SUCCESS where a step has no issue."""
    return spark.createDataFrame([(s, i or None, "FAIL" if i else "SUCCESS") for s, i in steps], "step string, issue string, status string")
