"""Nearest-neighbour retrieval of analogs: component-weighted distances, caps by group, softmax weights, synthesis inputs.

Targets are a stated query set. Up to `block` of them are searched in one pass over history, where every task keeps, of the rows it reads, the nearest `pool` of each
target; within a pass, blocks of targets meet batches of rows by matrix products, which leave few rows for exact distances. What is shuffled is pool rows a task and target, never the product of both tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components of the distance and their weights.
WEIGHTS = {"track": 1.0, "intensity": 1.5, "motion": 1.2, "environment": 1.2, "time": 0.8, "life_progress": 0.8}


def _blocks(targets: DataFrame, key: str, vector: str, group: str | None, size: int) -> Iterator[list]:
    """The targets in order of their key, so many at a time."""
    cols = [key, vector, *([group] if group else [])]
    last = None
    while True:
        page = targets.select(*cols) if last is None else targets.select(*cols).where(F.col(key) > last)
        rows = page.orderBy(key).limit(size).collect()
        if not rows:
            return
        yield rows
        last = rows[-1][key]


class _Nearest:
    """The nearest rows seen so far of each target, under one metric (a factor for each place of the vectors)."""

    def __init__(self, vectors: np.ndarray, scale: np.ndarray, pool: int) -> None:
        self.vectors, self.scale, self.root, self.pool = vectors, scale, np.sqrt(scale), pool
        self.scaled = vectors * self.root
        self.norms = (self.scaled**2).sum(1)
        self.best: list = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))] * len(vectors)
        self.limits = np.full(len(vectors), np.inf)  # the farthest of a full pool

    def meet(self, k: np.ndarray, g: np.ndarray, h: np.ndarray, barred: Callable[[slice], np.ndarray | None]) -> None:
        near = h * self.root
        own = (near**2).sum(1)
        for at in range(0, len(self.best), 256):
            some = slice(at, at + 256)
            d = own + self.norms[some, None] - 2 * self.scaled[some] @ near.T
            if (no := barred(some)) is not None:
                d[no] = np.inf
            # products err in the last digits: all rows within them of the limit are looked at
            top = self.limits[some]
            if d.shape[1] > self.pool:
                top = np.minimum(top, np.partition(d, self.pool - 1, axis=1)[:, self.pool - 1])
            slack = 1e-9 * (self.norms[some] + own.max())
            close = (d <= (top + slack)[:, None]) & np.isfinite(d)
            for i in np.flatnonzero(close.any(axis=1)):
                t, c = at + i, np.flatnonzero(close[i])
                exact = ((h[c] - self.vectors[t]) ** 2 * self.scale).sum(1)
                dist, key, grp = (np.concatenate([a, b]) for a, b in zip(self.best[t], (exact, k[c], g[c]), strict=True))
                order = np.lexsort((key, dist))[: self.pool]
                self.best[t] = dist[order], key[order], grp[order]
                if len(order) == self.pool:
                    self.limits[t] = dist[order[-1]]


def _scale(width: int, parts: Sequence[tuple] | None) -> np.ndarray:
    """The factor of each place: a part's weight over its number of places. Parts are slices or lists of places."""
    scale = np.ones(width)
    if parts is not None:
        scale[:] = 0
        for s, w in parts:
            scale[s] += w / len(scale[s])
    return scale


def neighbours(targets: DataFrame, history: DataFrame, target_key: str, history_key: str, vector: str, pool: int, slices: Mapping[str, tuple[slice, float]] | None = None, group: str | None = None, exclude: str | None = None, block: int = 1 << 14, root: bool = False) -> DataFrame:
    """The `pool` nearest history rows of each target: target_id, history_id, history_group, distance.

    Vectors are arrays of doubles without nulls. slices: parts of the vector and their weights; the distance is the weighted sum of
    the parts' mean squared differences. Without slices it is the squared Euclidean distance, or with root the Euclidean one.
    exclude: history rows of the target's own `group` ("group") or its own key ("self") don't count. Ties go to the smaller history key."""
    return neighbours_by_mode(targets, history, target_key, history_key, vector, pool, {"": slices}, group, exclude, block, root).drop("mode")


def neighbours_by_mode(targets: DataFrame, history: DataFrame, target_key: str, history_key: str, vector: str, pool: int, modes: Mapping[str, Mapping[str, tuple] | None], group: str | None = None, exclude: str | None = None, block: int = 1 << 14, root: bool = False) -> DataFrame:
    """`neighbours` under several metrics in one pass over history: mode, target_id, history_id, history_group, distance.

    modes: for each name the parts of the vector (slices or lists of places) and their weights, as in `neighbours`; places in no part of a mode are features
    that it leaves out. A task keeps a pool for each mode and target, so a pass takes block / modes targets."""
    schema = "mode string, target_id long, history_id long, history_group long, distance double"
    found = None
    parts = {m: list(p.values()) if p else None for m, p in modes.items()}
    hist = history.select(F.col(history_key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.coalesce((F.col(group) if group else F.lit(None)).cast("long"), F.lit(-1)).alias("g")).where("v is not null and k is not null")
    for rows in _blocks(targets.where(F.col(vector).isNotNull()), target_key, vector, group, max(1, block // len(parts))):
        ids, vectors = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
        groups = np.array([-1 if r[2] is None else r[2] for r in rows], np.int64) if group else None

        def run(batches: Iterator[pd.DataFrame], ids=ids, vectors=vectors, groups=groups) -> Iterator[pd.DataFrame]:
            pools = {m: _Nearest(vectors, _scale(vectors.shape[1], p), pool) for m, p in parts.items()}
            for x in batches:
                if not len(x):
                    continue
                k, g, h = x["k"].to_numpy(), x["g"].to_numpy(), np.stack(x["v"])
                barred = {"self": lambda s, k=k: k == ids[s, None], "group": lambda s, g=g: g == groups[s, None]}.get(exclude, lambda s: None)
                for nearest in pools.values():
                    nearest.meet(k, g, h, barred)
            for m, nearest in pools.items():
                for t, (dist, key, grp) in enumerate(nearest.best):
                    if len(key):
                        yield pd.DataFrame({"mode": m, "target_id": ids[t], "history_id": key, "history_group": grp, "distance": dist})

        got = hist.mapInPandas(run, schema)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return history.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("mode", "target_id").orderBy("distance", "history_id")
    found = found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= pool).drop("__n")
    return found.withColumn("distance", F.sqrt("distance")) if root else found


def diversified(pool: DataFrame, k: int = 20, cap: int = 3, by: Sequence[str] = ("target_id",)) -> DataFrame:
    """rank 1..k: the nearest of the pool (of each `by`) with at most `cap` a history group; if those are fewer than k, the nearest of the rest follow."""
    own = Window.partitionBy(*by, "history_group").orderBy("distance", "history_id")
    x = pool.withColumn("over", (F.row_number().over(own) > cap).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("over", "distance", "history_id"))
    x = x.withColumn("rank", rank).where(F.col("rank") <= k).drop("over")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("distance", "history_id")))


def softmax_weights(edges: DataFrame, distance: str = "distance", by: Sequence[str] = ("target_id",)) -> DataFrame:
    """similarity_weight: exp(-(d - least) / median), scaled to sum 1 a target (by); all alike if the median vanishes."""
    s = edges.groupBy(*by).agg(F.min(distance).alias("__lo"), F.percentile(distance, F.lit(0.5)).alias("__mid"), F.count("*").alias("__n"))
    x = edges.join(s, list(by))
    raw = F.when(F.col("__mid") > 1e-12, F.exp(-(F.col(distance) - F.col("__lo")) / F.col("__mid"))).otherwise(1.0)
    x = x.withColumn("__w", raw)
    total = F.sum("__w").over(Window.partitionBy(*by))
    return x.withColumn("similarity_weight", F.col("__w") / total).drop("__lo", "__mid", "__n", "__w")


def similarity(distance, n_features: int):
    """1 / (1 + d / sqrt(p)) of a Euclidean distance over p features."""
    return 1 / (1 + distance / float(np.sqrt(n_features)))


def usable_features(history: DataFrame, target: DataFrame, components: Mapping[str, Sequence[str]], leaks) -> dict[str, list[str]]:
    """The features of each component that both tables have, that leak nothing, and of which history isn't all missing."""
    names = [f for fs in components.values() for f in fs if f in history.columns and f in target.columns and not leaks.search(f)]
    counts = history.agg(*[F.count(f).alias(f) for f in names]).first().asDict() if names else {}
    return {c: [f for f in fs if counts.get(f)] for c, fs in components.items()}


def standardised(df: DataFrame, scale: DataFrame, features: Sequence[str], name: str = "vector") -> DataFrame:
    """name: the features as an array, each less its mean over its deviation, from scale (feature, mean, std). A missing value is the mean."""
    s = {r["feature"]: (r["mean"], r["std"]) for r in scale.where(F.col("feature").isin(list(features))).collect()}  # a row a feature
    return df.withColumn(name, F.array(*[F.coalesce((F.col(f) - s[f][0]) / s[f][1], F.lit(0.0)) for f in features]))


def edge_summary(edges: DataFrame) -> DataFrame:
    """A row per history sample: how often, how near and with what weight it was taken."""
    return edges.groupBy("history_id").agg(F.count("*").alias("n"), F.min("rank").alias("best_rank"), F.avg("rank").alias("mean_rank"), F.max("similarity_weight").alias("max_weight"), F.avg("similarity_weight").alias("mean_weight"), F.sum("similarity_weight").alias("sum_weight"))
