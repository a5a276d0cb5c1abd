"""Checks that are data: each returns rows, so that a caller can stop, log or go on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.columns import ContractError


def ranges(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(column, n, n_null, n_outside) in one pass."""
    rows = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(~F.col(c).between(lo, hi)).alias("n_outside")) for c, (lo, hi) in limits.items()]
    return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def rules(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(rule, n_failed, status): rows that don't meet each condition; an unknown one fails."""
    rows = [F.struct(F.lit(k).alias("rule"), F.count_if(~F.coalesce(c, F.lit(False))).alias("n_failed")) for k, c in checks.items()]
    x = df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return x.withColumn("status", F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL"))


def enforce(report: DataFrame) -> DataFrame:
    """The report of `rules`, if nothing failed."""
    if bad := [r["rule"] for r in report.where("status = 'FAIL'").collect()]:
        raise ContractError(f"failed: {', '.join(bad)}")
    return report


def verdict(value: Column, warn: float, fail: float) -> Column:
    return F.when(value.isNull() | (value >= fail), "FAIL").when(value >= warn, "WARNING").otherwise("PASS")


def agreement(one: DataFrame, other: DataFrame, on: Sequence[str], values: Sequence[str], close: float = 1e-6) -> DataFrame:
    """A row per value: the largest difference over the common keys, keys that only one side has, and identical, close or warning."""
    b = other.select(*on, *[F.col(v).alias(f"__b_{v}") for v in values]).withColumn("__r", F.lit(1))
    x = one.select(*on, *values).withColumn("__l", F.lit(1)).join(b, list(on), "full_outer")
    alone = F.count_if(F.col("__l").isNull() | F.col("__r").isNull())
    rows = [F.struct(F.lit(v).alias("column"), F.max(F.abs(F.col(v) - F.col(f"__b_{v}"))).alias("max_diff"), alone.alias("n_unmatched")) for v in values]
    x = x.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return x.withColumn("status", F.when((F.col("n_unmatched") > 0) | F.col("max_diff").isNull(), "warning").when(F.col("max_diff") == 0, "identical").when(F.col("max_diff") <= close, "close").otherwise("warning"))


def statuses(df: DataFrame, status: str = "status") -> DataFrame:
    """How often each status occurs: the log of a run whose rows carry their own."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def representative(df: DataFrame, by: Sequence[str], order: Sequence[str], metrics: Sequence[str], fractions: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), even: int = 20) -> DataFrame:
    """Rows of each series to look at: at fixed fractions of it, at each metric's first maximum, and evenly spread. `why` lists the reasons."""
    w = Window.partitionBy(*by)
    x = df.withColumns({"__n": F.row_number().over(w.orderBy(*order)) - 1, "__last": F.count("*").over(w) - 1})
    tops = {m: F.first("__n").over(w.orderBy(F.col(m).desc_nulls_last(), "__n")) for m in metrics}
    x = x.withColumns({f"__t_{m}": c for m, c in tops.items()})
    at = [F.when(F.col("__n") == F.round(q * F.col("__last")), f"fraction {q:g}") for q in fractions]
    at += [F.when((F.col("__n") == F.col(f"__t_{m}")) & F.col(m).isNotNull(), f"max {m}") for m in metrics]
    step = F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(even - 1)), lambda i: F.round(i * F.col("__last") / (even - 1)).cast("long")), F.col("__n").cast("long"))
    why = F.array_compact(F.array(*at, F.when(step, "even")))
    return x.withColumn("why", why).where(F.size("why") > 0).drop("__n", "__last", *[f"__t_{m}" for m in metrics])


def varied_choice(df: DataFrame, key: str, score: str, stratum: str, k: int, penalty: float = 0.2) -> list:
    """k keys with high scores from many strata: each further pick of a stratum costs `penalty` of the score's range.

    With equal penalties the greedy choice is the order of score less penalty times the place within the stratum: a window, no loop."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.col(score).desc(), key)) - 1
    span = df.agg((F.max(score) - F.min(score)).alias("__span"))
    x = df.join(F.broadcast(span)).withColumn("__s", F.col(score) - penalty * F.col("__span") * place)
    return [r[key] for r in x.orderBy(F.col("__s").desc(), key).limit(k).select(key).collect()]
