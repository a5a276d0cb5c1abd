"""Principal components of many packed fields (arrays of one length), where cells far outnumber fields.

The Gram matrix of the fields would be small only while fields are few; instead a randomised range finder works with any number of them: tasks multiply
their fields with a (cells x rank) matrix, the products are summed by blocks of cells, and only matrices of that size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom.operators.stats import percent_rank


@dataclass(frozen=True)
class Basis:
    """mean (cells), components (rank x cells), explained (share of the variance of each)."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray


def templates(edges: DataFrame, group: str, quota: int, cap: int) -> DataFrame:
    """Fields to learn from: a score of how near, how often and with what weight a sample was retrieved; a quota a group, and a cap over all."""
    x = edges
    for c, name in (("best_rank", "__r"), ("max_weight", "__w"), ("n", "__n")):
        x = percent_rank(x, [], c, name)
    x = x.withColumn("score", 0.45 * F.col("__w") + 0.35 * F.col("__n") + 0.20 * (1 - F.col("__r"))).drop("__r", "__w", "__n")
    own = Window.partitionBy(group).orderBy(F.col("score").desc(), "history_id")
    return x.withColumn("__k", F.row_number().over(own)).where(F.col("__k") <= quota).drop("__k").orderBy(F.col("score").desc(), "history_id").limit(cap)


def _sums(fields: DataFrame, field: str, product, width: int, block: int = 2048) -> np.ndarray:
    """The sum over all fields of product(matrix of fields) (cells x width), added up by blocks of cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x in batches:
            if len(x):
                p = product(np.stack(x[field]).astype(float))
                total = p if total is None else total + p
        if total is not None:
            for at in range(0, len(total), block):
                yield pd.DataFrame({"at": [at], "part": [total[at : at + block].ravel()]})

    def add(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [x["at"].iloc[0]], "part": [np.sum(np.stack(x["part"]), axis=0)]})

    schema = "at long, part array<double>"
    rows = fields.select(field).where(F.col(field).isNotNull()).mapInPandas(run, schema).groupBy("at").applyInPandas(add, schema).orderBy("at").collect()
    return np.concatenate([np.array(r["part"]) for r in rows]).reshape(-1, width)


def fit(fields: DataFrame, field: str, rank: int = 20, rounds: int = 4, seed: int = 0) -> Basis:
    """Leading components of log1p of the fields. Signs: the largest loading of each is positive."""
    n = fields.where(F.col(field).isNotNull()).count()
    s = _sums(fields, field, lambda a: np.stack([np.log1p(a).sum(0), (np.log1p(a) ** 2).sum(0)], axis=1), 2)
    mean, total = s[:, 0] / n, float((s[:, 1] - s[:, 0] ** 2 / n).sum())
    basis = np.random.default_rng(seed).standard_normal((len(mean), min(rank + 8, n, len(mean))))
    for _ in range(rounds):
        q = np.linalg.qr(basis)[0]
        basis = _sums(fields, field, lambda a, q=q: (np.log1p(a) - mean).T @ ((np.log1p(a) - mean) @ q), q.shape[1])
    small = q.T @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    components = (q @ vectors[:, order]).T
    components *= np.sign(components[np.arange(len(order)), np.abs(components).argmax(1)])[:, None]
    return Basis(mean, components, np.maximum(values[order], 0) / max(total, 1e-300))


@dataclass(frozen=True)
class _Sketch:
    """n fields seen: their mean, their scatter in all (sum of squares about the mean), and the leading part of it as rows (right vectors times singular values)."""

    n: int
    mean: np.ndarray
    scatter: float
    rows: np.ndarray


def _merged(one: _Sketch | None, other: _Sketch | None, keep: int) -> _Sketch | None:
    """Both sketches as one: the scatter of the means' difference is a row more."""
    if one is None or other is None:
        return one or other
    n, step = one.n + other.n, other.mean - one.mean
    apart = np.sqrt(one.n * other.n / n) * step
    stacked = np.concatenate([one.rows, other.rows, apart[None]])
    _, sizes, vectors = np.linalg.svd(stacked, full_matrices=False)
    kept = min(keep, len(sizes))
    return _Sketch(n, one.mean + step * other.n / n, one.scatter + other.scatter + float(apart @ apart), vectors[:kept] * sizes[:kept, None])


def _sketch(a: np.ndarray) -> _Sketch:
    centred = a - a.mean(0)
    return _Sketch(len(a), a.mean(0), float((centred**2).sum()), centred)


def fit_once(fields: DataFrame, field: str, rank: int = 20, batch: int = 128, spare: int = 12) -> Basis:
    """`fit` in one pass: every task folds its fields, `batch` at a time, into a sketch of rank + spare rows, and the tasks' sketches are merged in a tree.

    Exact for fields of no more than rank + spare dimensions; else what a sketch drops is the scatter beyond that rank. A sketch has rank + spare rows of
    cells, so what a merge holds, and what the driver gets at the end, doesn't grow with the fields."""
    keep = rank + spare

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, waiting = None, []
        for x in batches:
            waiting += list(x[field])
            while len(waiting) >= batch:
                seen, waiting = _merged(seen, _sketch(np.log1p(np.stack(waiting[:batch]).astype(float))), keep), waiting[batch:]
        if waiting:
            seen = _merged(seen, _sketch(np.log1p(np.stack(waiting).astype(float))), keep)
        if seen:
            yield pd.DataFrame({"n": [seen.n], "scatter": [seen.scatter], "mean": [seen.mean.tobytes()], "rows": [seen.rows.tobytes()]})

    def unpack(r) -> _Sketch:
        mean = np.frombuffer(r["mean"])
        return _Sketch(r["n"], mean, r["scatter"], np.frombuffer(r["rows"]).reshape(-1, len(mean)))

    made = fields.select(field).where(F.col(field).isNotNull()).mapInPandas(run, "n long, scatter double, mean binary, rows binary")
    none = fields.sparkSession.sparkContext.parallelize([None], 1)
    whole = made.rdd.map(unpack).union(none).treeReduce(lambda a, b: _merged(a, b, keep), depth=3)
    if whole is None:
        raise ValueError("no fields")
    _, sizes, vectors = np.linalg.svd(whole.rows, full_matrices=False)
    components = vectors[:rank]
    components = components * np.where(components[np.arange(len(components)), np.abs(components).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Basis(whole.mean, components, sizes[:rank] ** 2 / max(whole.scatter, 1e-300))


def project(fields: DataFrame, field: str, key: str, basis: Basis) -> DataFrame:
    """(key, scores)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield pd.DataFrame({key: x[key], "scores": list((np.log1p(np.stack(x[field]).astype(float)) - basis.mean) @ basis.components.T)})

    kind = dict(fields.dtypes)[key]
    return fields.select(key, field).where(F.col(field).isNotNull()).mapInPandas(run, f"{key} {kind}, scores array<double>")


def reconstruct(fields: DataFrame, field: str, key: str, basis: Basis, blend: float = 0.3) -> DataFrame:
    """(key, field, rmse, corr, energy_ratio): (1 - blend) of the field and blend of its reconstruction, not below 0; and how near the two are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            a = np.stack(x[field]).astype(float)
            b = np.maximum(np.expm1((np.log1p(a) - basis.mean) @ basis.components.T @ basis.components + basis.mean), 0)
            rmse = np.sqrt(((a - b) ** 2).mean(1))
            da, db = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            size = np.sqrt((da**2).sum(1) * (db**2).sum(1))
            with np.errstate(invalid="ignore", divide="ignore"):
                corr = np.where(size > 0, (da * db).sum(1) / size, np.nan)
                energy = np.where((a**2).sum(1) > 0, (b**2).sum(1) / (a**2).sum(1), np.nan)
            yield pd.DataFrame({key: x[key], field: list(np.maximum((1 - blend) * a + blend * b, 0)), "rmse": rmse, "corr": corr, "energy_ratio": energy})

    kind = dict(fields.dtypes)[key]
    out = fields.select(key, field).where(F.col(field).isNotNull()).mapInPandas(run, f"{key} {kind}, {field} array<double>, rmse double, corr double, energy_ratio double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("corr", "energy_ratio")})
