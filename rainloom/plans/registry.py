"""Registered queries: each by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Rounded to six places, zero without a sign: what two engines can agree on."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """df with its doubles rounded, counts as long."""
    out = {}
    for c, kind in df.dtypes:
        if c in keep:
            continue
        if kind in ("double", "float") or kind.startswith("decimal"):
            out[c] = r6(F.col(c).cast("double"))
        elif kind in ("int", "smallint", "tinyint"):
            out[c] = F.col(c).cast("long")
    return df.withColumns(out) if out else df
