"""Exact percentiles and ranks of columns of any length, without one task that orders a whole column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest finite double.
TOP = 1.7976931348623157e308


def _finite(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v), v)


def percentiles(df: DataFrame, by: Sequence[str], value: str | Column, levels: Sequence[float], name: str = "q", limit: int = 1 << 20, bins: int = 4096) -> DataFrame:
    """(by, name): the exact percentiles of each group as an array, linear between neighbours; null for groups without values. Not-a-number counts as missing.

    Groups of up to `limit` values are small, and take Spark's percentile, which holds a group's distinct values in one task. For larger ones (of which there are
    at most rows / limit; their bounds come to the driver) the order statistics are found by bins: rows are counted by bin of the interval that holds a rank,
    the bin that holds it becomes the next interval, until that has `limit` rows or one value. A pass reads the rows and shuffles counts, at most `bins` a rank."""
    x = df.select(*by, _finite(F.col(value) if isinstance(value, str) else value).alias("__v"))
    q = F.array(*[F.lit(float(p)) for p in levels])
    small = lambda rows: rows.groupBy(*by).agg(F.percentile("__v", q).alias(name))
    sizes = x.groupBy(*by).agg(F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    large = sizes.where(F.col("__n") > limit).collect()
    if not large:
        return small(x)
    keyed = x.withColumn("__k", F.to_json(F.struct(*by)) if by else F.lit(""))
    names = df.sparkSession.createDataFrame([tuple(r) for r in large], sizes.schema).withColumn("__k", F.to_json(F.struct(*by)) if by else F.lit("")).collect()
    keys = df.sparkSession.createDataFrame([(r["__k"],) for r in names], "__k string")
    rest = keyed.join(F.broadcast(keys), "__k", "left_anti") if by else None
    states, open_ = {}, []
    for r in names:
        for p in levels:
            at = p * (r["__n"] - 1)
            for rank in {int(at), min(int(at) + 1, r["__n"] - 1)}:
                states[r["__k"], rank] = (r["__lo"], r["__hi"], 0, r["__n"])
    while open_ := [(k, rank, lo, hi, before) for (k, rank), (lo, hi, before, n) in states.items() if n > limit and lo < hi]:
        found = _narrowed(keyed, open_, bins)
        if all(found[k, rank][:2] == (lo, hi) for k, rank, lo, hi, _ in open_):
            raise ArithmeticError("the intervals don't narrow")
        states |= found
    states |= _settled(keyed, [(k, rank, lo, hi, before) for (k, rank), (lo, hi, before, n) in states.items() if lo < hi])
    rows = []
    for r in names:
        got = []
        for p in levels:
            at = p * (r["__n"] - 1)
            a, b = (states[r["__k"], i][0] for i in (int(at), min(int(at) + 1, r["__n"] - 1)))
            got.append(a if a == b else a + (b - a) * (at - int(at)))
        rows.append((*[r[c] for c in by], got))
    schema = ", ".join([*[f"`{c}` {dict(df.dtypes)[c]}" for c in by], f"`{name}` array<double>"])
    out = df.sparkSession.createDataFrame(rows, schema)
    return out if rest is None else small(rest.drop("__k")).unionByName(out)


def _inside(keyed: DataFrame, intervals: list[tuple]) -> DataFrame:
    """The rows in the intervals (key, rank, lo, hi, before) of their group, once for each: as many as there are ranks in large groups, so they are broadcast."""
    s = keyed.sparkSession.createDataFrame(intervals, "__k string, __rank long, __lo double, __hi double, __before long")
    return keyed.join(F.broadcast(s), "__k").where(F.col("__v").between(F.col("__lo"), F.col("__hi")))


def _narrowed(keyed: DataFrame, intervals: list[tuple], bins: int) -> dict:
    lo, hi, v = (F.greatest(F.lit(-TOP), F.least(F.lit(TOP), F.col(c))) for c in ("__lo", "__hi", "__v"))
    share = F.when(hi - lo <= TOP, (v - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))  # halves where the width isn't finite
    inner = F.least(F.lit(bins - 3), F.floor(F.coalesce(share, F.lit(0.0)) * (bins - 2))) + 1
    place = F.when(F.col("__v") < -TOP, 0).when(F.col("__v") > TOP, bins - 1).otherwise(inner).cast("int")
    key = ["__k", "__rank"]
    cells = _inside(keyed, intervals).groupBy(*key, "__before", place.alias("__bin")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    upto = F.col("__before") + F.sum("n").over(Window.partitionBy(*key).orderBy("__bin"))
    cells = cells.withColumn("upto", upto).where((F.col("__rank") < F.col("upto")) & (F.col("__rank") >= F.col("upto") - F.col("n")))
    return {(r["__k"], r["__rank"]): (r["lo"], r["hi"], r["upto"] - r["n"], r["n"]) for r in cells.collect()}


def _settled(keyed: DataFrame, intervals: list[tuple]) -> dict:
    if not intervals:
        return {}
    key = ["__k", "__rank"]
    cells = _inside(keyed, intervals).groupBy(*key, "__before", "__v").agg(F.count("*").alias("n"))
    upto = F.col("__before") + F.sum("n").over(Window.partitionBy(*key).orderBy("__v"))
    cells = cells.withColumn("upto", upto).where((F.col("__rank") < F.col("upto")) & (F.col("__rank") >= F.col("upto") - F.col("n")))
    return {(r["__k"], r["__rank"]): (r["__v"], r["__v"], 0, 1) for r in cells.collect()}


def with_ranges(df: DataFrame, columns: Sequence[str], suffix: str = "__range") -> DataFrame:
    """df with <column><suffix>: the number of the range of values that holds the column's value, about as many rows in each; ranges rise with the values.

    There are as many as shuffle partitions, 64 at least. Their edges are approximate quantiles, so they come to the driver; where they lie decides
    how even the ranges are and never a result."""
    from pyspark.ml.feature import Bucketizer

    n = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = df.withColumns({f"__e_{c}": _finite(F.col(c)) for c in columns})
    edges = x.approxQuantile([f"__e_{c}" for c in columns], [i / n for i in range(1, n)], 1 / (4 * n))
    splits = [[-float("inf"), *sorted({e for e in es if abs(e) <= TOP}), float("inf")] for es in edges]
    splits = [s if len(s) > 2 else [s[0], 0.0, s[-1]] for s in splits]
    cut = Bucketizer(inputCols=[f"__e_{c}" for c in columns], outputCols=[f"{c}{suffix}" for c in columns], splitsArray=splits, handleInvalid="keep")
    return cut.transform(x).drop(*[f"__e_{c}" for c in columns])


def upto(counts: DataFrame, by: Sequence[str], value: str, count: str, in_range: str, name: str, total: str) -> DataFrame:
    """counts (a row per group and distinct value) with name: how many rows of the group have that value or a smaller one; and the group's total.

    The ranges' totals (a row a range) are run up first; within a range its values are ordered by a task of its own."""
    sizes = counts.groupBy(*by, in_range).agg(F.sum(count).alias("__size"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__size").over(w.orderBy(in_range).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col(in_range).alias("__b_range"), before.alias("__before"), F.sum("__size").over(w).alias(total))
    same = F.col(in_range).eqNullSafe(F.col("__b_range"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    x = counts.join(sizes, same)
    own = Window.partitionBy(*by, in_range).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn(name, F.col("__before") + F.sum(count).over(own)).drop("__before", "__b_range", *[f"__b_{c}" for c in by])
