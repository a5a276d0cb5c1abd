"""Gaps filled by a chain of rules, each value with the rule that it comes from, and none left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules: between the known values of the series (ends take the nearest), the series' median, the table's most frequent value, the history's median, zero.
INTERPOLATED, GROUP_MEDIAN, MODE, HISTORY_MEDIAN, ZERO = "interpolated", "group_median", "mode", "history_median", "zero"
OWN = "own"


def _known(value: str) -> Column:
    """value as a double, null where it is no finite number."""
    v = F.col(value).try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _between(value: str, by: Sequence[str], at: Column, order: Sequence[str]) -> Column:
    """The straight line between the nearest known values before and behind, by `at`; beyond the ends the nearest one."""
    w = Window.partitionBy(*by).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull() & at.isNotNull(), F.struct(at.cast("double").alias("t"), F.col(value).alias("v")))
    a, b = F.last(point, ignorenulls=True).over(back), F.first(point, ignorenulls=True).over(ahead)
    share = F.coalesce((at - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0)), F.lit(0.0))
    return F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share)


def impute(df: DataFrame, history: DataFrame, by: Sequence[str], order: Sequence[str], chains: Mapping[str, Sequence[str]], at: Column | None = None) -> DataFrame:
    """df with every column of chains filled, and <column>_source: own, or the first rule of its chain that had a value.

    chains: the rules of each column, in order; what no rule fills is 0 (source zero). at: the axis of interpolation, the row's place in its series where
    it isn't given. Medians are exact; the most frequent value is the smallest of several. A value that is no finite number counts as missing, also in history.
    Series (by) are tracks: one is a task's work. If a null were left, the query would fail with the column's name."""
    columns = list(df.columns)
    if unknown := {r for rules in chains.values() for r in rules} - {INTERPOLATED, GROUP_MEDIAN, MODE, HISTORY_MEDIAN, ZERO}:
        raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
    uses = lambda rule: [c for c, rules in chains.items() if rule in rules]
    x = df.withColumns({c: _known(c) for c in chains})
    median = lambda c: F.percentile(c, F.lit(0.5))
    if uses(INTERPOLATED):
        axis = at if at is not None else F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        x = x.withColumn("__at", axis.cast("double"))
        x = x.withColumns({f"__{INTERPOLATED}_{c}": _between(c, by, F.col("__at"), order) for c in uses(INTERPOLATED)})
    if uses(GROUP_MEDIAN):
        # what interpolation fills counts in the median, as it comes first in a chain
        filled = {c: F.coalesce(F.col(c), F.col(f"__{INTERPOLATED}_{c}")) if INTERPOLATED in chains[c][: list(chains[c]).index(GROUP_MEDIAN)] else F.col(c) for c in uses(GROUP_MEDIAN)}
        g = x.groupBy(*by).agg(*[median(v).alias(f"__{GROUP_MEDIAN}_{c}") for c, v in filled.items()])
        x = x.join(g.select(*[F.col(c).alias(f"__by_{c}") for c in by], *[f"__{GROUP_MEDIAN}_{c}" for c in filled]), [x[c].eqNullSafe(F.col(f"__by_{c}")) for c in by], "left")
    for c in uses(MODE):
        counts = x.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n"))
        x = x.join(F.broadcast(counts.agg(F.min_by("__v", F.struct((-F.col("__n")).alias("n"), "__v")).alias(f"__{MODE}_{c}"))))  # one row
    if uses(HISTORY_MEDIAN):
        h = history.select(*[_known(c).alias(c) for c in uses(HISTORY_MEDIAN)])
        x = x.join(F.broadcast(h.agg(*[median(c).alias(f"__{HISTORY_MEDIAN}_{c}") for c in uses(HISTORY_MEDIAN)])))  # one row
    out: dict[str, Column] = {}
    for c, rules in chains.items():
        steps = [(OWN, F.col(c)), *[(r, F.lit(0.0) if r == ZERO else F.col(f"__{r}_{c}")) for r in rules], (ZERO, F.lit(0.0))]
        value = F.coalesce(*[v for _, v in steps])
        out[c] = F.coalesce(value, F.raise_error(F.lit(f"{c} has gaps")).cast("double"))
        out[f"{c}_source"] = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in steps])
    return x.withColumns(out).select(*columns, *[f"{c}_source" for c in chains])


def fill_report(imputed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, source, n, share): where the values of each column come from."""
    long = imputed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_source").alias("source")) for c in columns])).alias("s")).select("s.*")
    counts = long.groupBy("feature", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))
