"""Rank statistics, splits and models over feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.clean import safe_ratio
from rainloom.operators import selection


def percent_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank over the number of values, in (0, 1]. Equal values are counted first, so only distinct values are ordered, each range of them by itself."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    c = selection.upto(selection.with_ranges(c, [value], "__r"), by, value, "__c", f"{value}__r", "__upto", "__all")
    c = c.select(*by, value, ((F.col("__upto") - (F.col("__c") - 1) / 2) / F.col("__all")).alias(name))
    return df.join(c, [*by, value], "left")


def spearman(df: DataFrame, xs: Sequence[str], ys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x, y, rho, n) for every pair of columns: rank correlation with average ranks over the rows that have both.

    Rows are counted by the two values of each pair first, so that ranges, ranks and sums are made of the counts. Ranks come from counts of equal values, by
    ranges of values, so that no task orders a whole column."""
    pairs = [(a, b) for a in xs for b in ys if a != b]
    parts = []
    for i, (a, b) in enumerate(pairs):
        both = df.select(*by, F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v")).where("u is not null and v is not null")
        parts.append(both.groupBy(*by, "u", "v").agg(F.count("*").alias("c")).select(*by, F.lit(i).alias("pair"), "u", "v", "c"))
    counted = reduce(DataFrame.unionAll, parts).persist()  # the edges and every step below read it
    cells, key = selection.with_ranges(counted, ["u", "v"], "r"), [*by, "pair"]

    def ranks(value: str, name: str) -> DataFrame:
        one = cells.groupBy(*key, value, f"{value}r").agg(F.sum("c").alias("k"))
        return selection.upto(one, key, value, "k", f"{value}r", "upto", "n").select(*key, value, (F.col("upto") - (F.col("k") - 1) / 2).alias(name), F.col("n").alias(f"n_{name}"))

    x = cells.join(ranks("u", "ru"), [*key, "u"]).join(ranks("v", "rv").drop("n_rv"), [*key, "v"]).withColumnRenamed("n_ru", "n")
    c = F.col("c")
    # all ranks have the mean (n + 1) / 2; moments about it, from the counts
    x = x.withColumns({"a": F.col("ru") - (F.col("n") + 1) / 2, "b": F.col("rv") - (F.col("n") + 1) / 2})
    rho = x.groupBy(*key, "n").agg(safe_ratio(F.sum(c * F.col("a") * F.col("b")), F.sqrt(F.sum(c * F.col("a") * F.col("a")) * F.sum(c * F.col("b") * F.col("b")))).alias("rho"))
    name = lambda at: F.element_at(F.array(*[F.lit(p[at]) for p in pairs]), F.col("pair") + 1)
    return rho.select(*by, name(0).alias("x"), name(1).alias("y"), "rho", "n")


def top_correlations(rho: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.abs("rho").desc_nulls_last(), "x", "y")
    return rho.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def group_split(df: DataFrame, key: str, share: float = 0.25, seed: int = 0) -> DataFrame:
    """is_test: whole groups, about the share of them, by the hash of key and seed. Nothing is shuffled."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < round(10_000 * share))


def regression_scores(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """r2, mae and rmse, and those of predicting the mean."""
    x = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    d = F.col(truth) - F.col(predicted)
    s = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.var_pop(truth).alias("var"))
    return s.select(*by, "n", (1 - safe_ratio(F.col("mse"), F.col("var"))).alias("r2"), "mae", F.sqrt("mse").alias("rmse"), F.sqrt("var").alias("baseline_rmse"))


#: Rows that a forest learns from one by one; larger tables are condensed first.
FEW = 1 << 16


def condense(train: DataFrame, features: Sequence[str], target: str, shares: int = 16) -> DataFrame:
    """(features, target, __weight): rows of equal features as `shares` rows at most, dealt by the hash of the whole row, each with the mean of its rows' targets
    and their number.

    No row is left out, and a tree loses nothing: equal features are never parted, and by how much a split lowers the variance follows from means and numbers."""
    share = F.pmod(F.xxhash64(*[F.col(c) for c in train.columns]), F.lit(shares))
    x = train.where(F.col(target).isNotNull()).groupBy(*features, share.alias("__share"))
    return x.agg(F.avg(target).alias(target), F.count("*").cast("double").alias("__weight")).drop("__share")


def forest(train: DataFrame, features: Sequence[str], target: str, trees: int = 250, depth: int = 14, leaf: int = 20, seed: int = 0):
    """A random forest regression over all features at every split; returns what turns a table into one with `prediction`.

    Tables of more than `FEW` rows are condensed, so that rows of few distinct features cost one pass and not one a level of every tree. The bootstrap then draws
    shares of equal features, and the least size of a leaf counts rows by weight."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    assembler = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="skip")
    rf = RandomForestRegressor(featuresCol="__features", labelCol=target, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
    rows = assembler.transform(train.where(F.col(target).isNotNull()))
    n = rows.count()
    if n > FEW:
        few = condense(train, features, target).persist()
        tasks = min(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + few.count() // 10_000)
        rows = assembler.transform(few.repartition(tasks))  # each task sums up all nodes of a level
        rf = rf.setWeightCol("__weight").setMinWeightFractionPerNode(min(leaf / n, 0.49))
    else:
        few, rf = None, rf.setMinInstancesPerNode(leaf)
    model = rf.fit(rows)
    if few is not None:
        few.unpersist()
    return lambda df: model.transform(assembler.transform(df)).drop("__features")


def permutation_importance(df: DataFrame, features: Sequence[str], target: str, predict, repeats: int = 10, key: str = "__row", seed: int = 0) -> DataFrame:
    """(feature, importance): the mean fall of r2 when a column's values change rows at random. key must identify rows.

    In each turn every row, at its place in the order of that turn's hash, meets the row at that place in one fixed order: places are exact and come from range-partitioned
    sorts, so tables of any length are permuted, and one meeting serves all features. Rows of a turn with equal features have one prediction: they are summed up
    first, about the target's mean."""
    df = df.select(key, *features, target)
    y = F.col("__y")
    mean = df.agg(F.avg(target)).first()[0]
    sums = [F.count("__y").alias("n"), F.sum("__y").alias("s"), F.sum(y * y).alias("q")]
    values = lambda by, rows: rows.groupBy(*by, *features).agg(*sums)
    p = F.col("prediction") - F.lit(mean)
    left = F.sum(F.col("q") - 2 * p * F.col("s") + F.col("n") * p * p)
    own = df.select(key, *features, (F.col(target) - F.lit(mean)).alias("__y"))
    r2 = (1 - safe_ratio(left, F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n"))).alias("r2")
    base = predict(values([], own)).agg(r2).first()["r2"]
    turns = own.select(F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("__turn"), "*")  # all repeats of a feature in one job
    a = _placed(turns, F.xxhash64(F.lit(seed), "__turn", key), key, ["__turn"]).drop(key)
    b = _placed(own, F.xxhash64(F.lit(~seed), key), key).select("__place", F.struct(*features).alias("__other"))
    mixes = F.array(*[F.struct(F.lit(i).alias("__f"), *[F.col(f"__other.{c}" if c == f else c).alias(c) for c in features]) for i, f in enumerate(features)])
    mixed = a.join(b, "__place").select("__turn", "__y", F.explode(mixes).alias("__m")).select("__turn", "__y", "__m.*")
    falls = predict(values(["__turn", "__f"], mixed)).groupBy("__turn", "__f").agg(r2)
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("__f") + 1).alias("feature")
    return falls.select(name, (F.lit(base) - F.col("r2")).alias("fall")).groupBy("feature").agg(F.avg("fall").alias("importance"), F.stddev_samp("fall").alias("importance_std"))


def _placed(df: DataFrame, order, key: str, by: Sequence[str] = ()) -> DataFrame:
    """__place: 1, 2, ... within each group of `by` in the order of the hash: places within ranges of it, behind the counts of the ranges before. There are eight ranges a shuffle partition, 256 at least."""
    bits = max(8, (8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    x = df.withColumn("__h", order).withColumn("__b", F.shiftright("__h", 64 - bits))
    sizes = x.groupBy(*by, "__b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    x = x.join(sizes.select(*by, "__b", before.alias("__before")), [*by, "__b"])
    return x.withColumn("__place", F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key))).drop("__h", "__b", "__before")


def compare_splits(scores: DataFrame, by: Sequence[str], split: str, base: str, other: str) -> DataFrame:
    """scores (by, split, r2, mae, rmse) of two ways to split, side by side: what the other one costs in r2, and in percent of mae."""
    a, b = (scores.where(F.col(split) == s).select(*by, F.col("r2").alias(f"{s}_r2"), F.col("mae").alias(f"{s}_mae")) for s in (base, other))
    x = a.join(b, list(by)) if by else a.join(F.broadcast(b))  # a row each
    return x.withColumns({"r2_drop": F.col(f"{base}_r2") - F.col(f"{other}_r2"), "mae_increase_pct": 100 * safe_ratio(F.col(f"{other}_mae") - F.col(f"{base}_mae"), F.col(f"{base}_mae"))})


def refit(baseline: DataFrame, changed: DataFrame, by: Sequence[str], source: str, derived: str) -> DataFrame:
    """changed with `derived` as the straight line in `source` that fits the baseline's rows of the same group; kept where the baseline gives no line."""
    slope, mid_x, mid_y = F.regr_slope(derived, source), F.regr_avgx(derived, source), F.regr_avgy(derived, source)
    fit = baseline.groupBy(*by).agg(slope.alias("__slope"), (mid_y - slope * mid_x).alias("__at0"))
    x = changed.join(fit, list(by), "left") if by else changed.join(F.broadcast(fit))  # one row
    return x.withColumn(derived, F.coalesce(F.col("__at0") + F.col("__slope") * F.col(source), F.col(derived))).drop("__slope", "__at0")
