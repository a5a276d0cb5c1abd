"""Repeated validation with whole groups held out: all splits in one table, models by repeat, scores beside those of the mean."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions.clean import safe_ratio
from rainloom.operators import stats

#: A model: from rows with repeat, is_test, features and __y to the same rows with prediction, having learned from those that aren't is_test.
Model = Callable[[DataFrame, Sequence[str], str], DataFrame]


def group_splits(df: DataFrame, key: str, repeats: int = 20, share: float = 0.25, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Every row once a repeat (1, 2, ...), with is_test: in each repeat about the share of the groups, whole, is held out.

    draw: a number in [0, 1) from `repeat` and the key; by default a hash with the seed. Nothing is shuffled, and no group is in both parts of a repeat."""
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    number = F.pmod(F.xxhash64(F.lit(seed), "repeat", key), F.lit(1 << 20)) / float(1 << 20) if draw is None else draw
    return x.withColumn("is_test", number < share)


def line_by_repeat(rows: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """The straight line in the first feature, for all repeats in one aggregate."""
    x = features[0]
    fit = rows.where("not is_test").groupBy("repeat").agg(F.regr_slope(y, x).alias("__slope"), F.regr_intercept(y, x).alias("__at0"))
    return rows.join(F.broadcast(fit), "repeat").withColumn("prediction", F.col("__at0") + F.col("__slope") * F.col(x)).drop("__slope", "__at0")  # a row a repeat


def forest_by_repeat(trees: int = 250, depth: int = 14, leaf: int = 20, seed: int = 42) -> Model:
    """A random forest for each repeat, each trained over the whole cluster, one repeat after the other."""

    def model(rows: DataFrame, features: Sequence[str], y: str) -> DataFrame:
        out = None
        for (r,) in rows.select("repeat").distinct().orderBy("repeat").collect():  # a row a repeat
            one = rows.where(F.col("repeat") == r)
            done = stats.forest(one.where("not is_test"), features, y, trees, depth, leaf, seed)(one)
            out = done if out is None else out.unionByName(done)
        return out

    return model


def validate(df: DataFrame, key: str, features: Sequence[str], target: str, model: Model, repeats: int = 20, share: float = 0.25, seed: int = 0, log: bool = False, draw: Column | None = None) -> DataFrame:
    """A row per repeat: n_train, n_test, n_train_groups, n_test_groups, train_r2, test_r2, test_r2_model, test_mae, test_rmse, baseline_mae, baseline_rmse.

    Rows with a gap in a feature, the target or the key are left out. log: the model learns log1p of the target, and its predictions are taken back; scores
    are on the target's own scale, but for test_r2_model, which is on the model's. baseline: the training rows' mean as the prediction of every test row.
    A repeat whose test or training part is empty has null scores."""
    used = df.select(key, *features, target).dropna()
    rows = group_splits(used, key, repeats, share, seed, draw).withColumn("__y", F.log1p(target) if log else F.col(target).cast("double"))
    x = model(rows, features, "__y")
    p, t, test = (F.expm1("prediction") if log else F.col("prediction")), F.col(target).cast("double"), F.col("is_test")
    mean = rows.where("not is_test").groupBy("repeat").agg(F.avg(F.col(target).cast("double")).alias("__mean"))
    x = x.join(F.broadcast(mean), "repeat", "left").withColumns({"__p": p, "__t": t, "__m": F.col("prediction")})
    of = lambda c, part: F.when(part, c)
    r2 = lambda a, b, part: 1 - safe_ratio(F.avg(of(F.pow(F.col(a) - F.col(b), 2), part)), F.var_pop(of(F.col(a), part)))
    error, plain = F.col("__t") - F.col("__p"), F.col("__t") - F.col("__mean")
    return x.groupBy("repeat").agg(
        F.count_if(~test).alias("n_train"), F.count_if(test).alias("n_test"), F.count_distinct(of(F.col(key), ~test)).alias("n_train_groups"), F.count_distinct(of(F.col(key), test)).alias("n_test_groups"),
        r2("__t", "__p", ~test).alias("train_r2"), r2("__t", "__p", test).alias("test_r2"), r2("__y", "__m", test).alias("test_r2_model"),
        F.avg(of(F.abs(error), test)).alias("test_mae"), F.sqrt(F.avg(of(error * error, test))).alias("test_rmse"), F.avg(of(F.abs(plain), test)).alias("baseline_mae"), F.sqrt(F.avg(of(plain * plain, test))).alias("baseline_rmse"),
    )


def summarise(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of every score over the repeats, and by how much the model's mae and rmse lie below the baseline's, in percent."""
    values = [c for c in scores.columns if c not in (*by, "repeat")]
    x = scores.groupBy(*by).agg(F.count("*").alias("n_repeats"), *[a for c in values for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])
    gain = lambda m: 100 * safe_ratio(F.col(f"baseline_{m}_mean") - F.col(f"test_{m}_mean"), F.col(f"baseline_{m}_mean"))
    return x.withColumns({f"{m}_gain_pct": gain(m) for m in ("mae", "rmse")})
