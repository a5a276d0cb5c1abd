"""Column names as data: aliases, contracts, deny lists, order. Everything here looks at df.columns only."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table lacks columns, or has some that it mustn't."""


def require(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"{what} lacks {', '.join(missing)}")
    return df


@dataclass(frozen=True)
class Resolver:
    """Candidate names by meaning; the first that a table has is taken."""

    candidates: Mapping[str, tuple[str, ...]]

    def found(self, df: DataFrame) -> dict[str, str]:
        return {want: next(c for c in names if c in df.columns) for want, names in self.candidates.items() if any(c in df.columns for c in names)}

    def apply(self, df: DataFrame) -> DataFrame:
        """df with the meanings as columns beside its own; a column that already has the name stays."""
        return df.withColumns({want: F.col(have) for want, have in self.found(df).items() if want not in df.columns})


#: Names under which best-track tables carry the same things.
TRACK = Resolver({"lon": ("lon", "track_lon_180", "track_lon", "lon_180", "longitude"), "lat": ("lat", "track_lat", "latitude"), "time": ("time", "gpm_time", "datetime"), "wind": ("wind", "track_wind"), "pressure": ("pressure", "track_pressure")})

#: Columns from which a target's answer could be read.
LEAKS = re.compile(r"(?i)rain|precip|(^|_)(r50|r80|r90|p9[059]|owd)(_|$)|target_|label")


def prefixed(df: DataFrame, prefix: str, but: Iterable[str] = ()) -> DataFrame:
    """Every column with the prefix once, except those named."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in set(but) and not c.startswith(prefix)})


def without(df: DataFrame, pattern: re.Pattern) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in df.columns if not pattern.search(c)])


def ordered(df: DataFrame, first: Iterable[str]) -> DataFrame:
    """The named columns first, all others behind them as they come."""
    first = [c for c in first if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def assert_no_leakage(df: DataFrame, pattern: re.Pattern = LEAKS, allowed: Iterable[str] = ()) -> DataFrame:
    if bad := [c for c in df.columns if pattern.search(c) and c not in set(allowed)]:
        raise ContractError(f"columns that leak the answer: {', '.join(bad)}")
    return df


def classify(name: str, inputs: Iterable[str], keys: Iterable[str], pattern: re.Pattern = LEAKS) -> tuple[str, str]:
    """(class, action) of a column."""
    if name in set(keys):
        return "metadata", "keep"
    if pattern.search(name):
        return "leakage", "drop"
    return ("input", "keep") if name in set(inputs) else ("review", "ask")


def audit(spark: SparkSession, tables: Mapping[str, DataFrame], inputs: Iterable[str], keys: Iterable[str]) -> DataFrame:
    """(table, position, column, type, class, action) of all columns of the tables; only schemas are read."""
    rows = [(t, i, c, kind, *classify(c, inputs, keys)) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, class string, action string")
