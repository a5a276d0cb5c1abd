"""Coercion, guards and identifiers as column expressions. Missing is NULL throughout; NaN and infinities become NULL where data come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def all_finite(df: DataFrame) -> DataFrame:
    """df with NaN and infinities of its floating columns as NULL."""
    return df.withColumns({c: finite(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}) if df.columns else df


def to_number(x: Column) -> Column:
    """A double, or NULL where the text is no number."""
    return finite(x.try_cast("double"))


def to_time(x: Column, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(x, F.lit(pattern)) if pattern else F.try_to_timestamp(x)


def safe_ratio(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """a / b, NULL where b is missing or all but zero."""
    return F.when(F.abs(b) > eps, a / b)


def first_present(*cols: Column) -> Column:
    """The first finite value of a row."""
    return F.coalesce(*[finite(c) for c in cols])


def flag(cond: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def plain_name(x: Column) -> Column:
    """Upper case, letters A-Z and digits only."""
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def uid(*parts: Column, width: int = 4) -> Column:
    """Parts joined by underscores, the last padded with zeros."""
    return F.concat_ws("_", *parts[:-1], F.lpad(parts[-1].cast("string"), width, "0"))


def ladder(x: Column, *steps: tuple[float, str], above: str, missing: str) -> Column:
    """The name of the first step that x doesn't exceed."""
    out = F.when(x.isNull(), missing)
    for limit, name in steps:
        out = out.when(x <= limit, name)
    return out.otherwise(above)


def clipped(x: Column, lo: float | Column, hi: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lit(lo)), lit(hi)))


def rain_value(x: Column, nodata: float = -9999.0, most: float | None = None) -> Column:
    """A cleaned rain rate: nodata and absurd values NULL, negatives 0."""
    x = F.when(F.abs(x - nodata) > 1e-6, finite(x))
    x = F.when(x < 0, 0.0).otherwise(x)
    return x if most is None else F.when(x <= most, x)
