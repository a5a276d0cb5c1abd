"""Hard negatives: rows of another label that score nearly as high against an anchor as the anchor's positives do.

Anchors are a stated query set and meet all rows in blocks: a cell holds so many anchors and so many rows at most, computes their integer
scores by one matrix product, and sorts each anchor's scores in full, by score from the highest and then by id. A first pass keeps each cell's
first rows of the anchor's own label, whose merge gives the positives. A second pass sorts again, finds each positive's upper limit in
the sorted scores by binary search, and reads on from there until it has k rows of another label or is below the lower limit; the cells' finds
are merged likewise. What leaves a cell is bounded by anchors, positives and k, and no cell depends on how many rows share a label or a vector.

Cases: a row with a null label, a null vector or a null or non-finite component takes no part; a row with a null id is no anchor, and comes last
among equal scores. Other rows than the anchor are those with another id; rows that repeat an id count one by one, also as anchors. Vectors
meet only vectors of the same length; empty ones score 0. Scores are exact while they and the components' squares fit 63 bits. Labels keep their
place in the ring of `labels` by the remainder that isn't negative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.llm.common import stash

#: Scores that a cell holds at once; more anchors are taken in turns.
AT_ONCE = 1 << 21
#: Where an id is null: behind all others.
NO_ID = np.iinfo(np.int64).max


def usable_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row (its own number), id, label, vector, of the rows that take part."""
    x = F.col(vector)
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ok = df.where(x.isNotNull() & F.col(label).isNotNull() & F.forall(x, real))
    return ok.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("vector"))


def relabelled(label: Column, id_: Column, every: int, labels: int) -> Column:
    """The next label of the ring for ids divisible by `every`."""
    return F.when(id_ % every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)


def _whole(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Rows of vectors as a matrix of whole numbers: floor(scale * x) in doubles."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if column.num_chunks else np.zeros(0)
    return np.floor(scale * flat.astype(float)).astype(np.int64).reshape(len(column), -1 if len(flat) else 0)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers, through floats where all partial sums (bounded by the norms) are exact there."""
    bound = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0)) + 1
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _sorted(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of each row of scores from the highest, of equal ones the first place first."""
    bits = max(1, int(scores.shape[1] - 1).bit_length())
    if scores.size and np.abs(scores).max() >= 1 << (62 - bits):
        order = np.lexsort((np.broadcast_to(np.arange(scores.shape[1]), scores.shape), -scores), axis=1)
        return order, np.take_along_axis(scores, order, 1)
    packed = np.sort((-scores << bits) | np.arange(scores.shape[1]), axis=1)
    return packed & ((1 << bits) - 1), -(packed >> bits)


def _in_cells(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(anchors, rows) in every cell of the grid: anchors and rows are dealt evenly by their row numbers, each anchor goes to every column
    of the grid and each row to every line of it."""
    g, h = grid
    deal = lambda n: F.pmod(F.col("row") + F.shiftright("row", 33), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("vector").alias("dims")
    a = anchors.toDF(*anchors.columns).select("*", size, deal(g).alias("g"), each(h).alias("h"))
    b = rows.toDF(*rows.columns).select("*", size, deal(h).alias("h"), each(g).alias("g"))
    key = ["dims", "g", "h"]
    return a.groupBy(key).cogroup(b.groupBy(key)).applyInArrow(work, schema)


def _turns(anchors: pa.Table, rows: pa.Table, scale: int) -> Iterator[tuple]:
    """(anchor's place, places of rows and scores from the highest, ids, labels) of every anchor. Rows are put in order of their ids first."""
    ids = rows["id"].fill_null(NO_ID).to_numpy()
    order = np.lexsort((rows["row"].to_numpy(), ids))
    ids, labels, b = ids[order], rows["label"].to_numpy()[order], _whole(rows["vector"], scale)[order]
    a, step = _whole(anchors["vector"], scale), max(1, AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), step):
        places, scores = _sorted(_products(a[at : at + step], b))
        for i in range(len(places)):
            yield at + i, places[i], scores[i], ids, labels


def _find_positives(anchors: pa.Table, rows: pa.Table, n: int, scale: int) -> pa.Table:
    """The n first rows of the anchor's label in this cell."""
    out: list[list] = [[], [], []]
    if len(anchors) and len(rows):
        key, own, label = (anchors[c].to_numpy() for c in ("row", "id", "label"))
        for i, place, score, ids, labels in _turns(anchors, rows, scale):
            hit = np.flatnonzero((labels[place] == label[i]) & (ids[place] != own[i]))[:n]
            for o, v in zip(out, (np.full(len(hit), key[i]), ids[place[hit]], score[hit]), strict=True):
                o.append(v)
    return _table(out, ["row", "positive_id", "score"])


def _find_negatives(anchors: pa.Table, rows: pa.Table, k: int, least: int, most: int, scale: int) -> pa.Table:
    """For each positive of an anchor the first k rows of other labels in this cell between the limits."""
    out: list[list] = [[], [], [], []]
    if len(anchors) and len(rows):
        key, own, label, positives = anchors["row"].to_numpy(), anchors["id"].to_numpy(), anchors["label"].to_numpy(), anchors["scores"].to_pylist()
        for i, place, score, ids, labels in _turns(anchors, rows, scale):
            other = np.flatnonzero((labels[place] != label[i]) & (ids[place] != own[i]))
            down = -score[other]  # ascending
            for j, p in enumerate(positives[i]):
                start = np.searchsorted(down, -(most * p // 100), "left")
                hit = other[start : start + k]
                hit = hit[score[hit] >= -(-least * p // 100)]
                for o, v in zip(out, (np.full(len(hit), key[i]), np.full(len(hit), j), ids[place[hit]], score[hit]), strict=True):
                    o.append(v)
    return _table(out, ["row", "j", "negative_id", "score"])


def _table(columns: list[list], names: list[str]) -> pa.Table:
    return pa.table([pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in columns], names)


def mine(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, shift_every: int = 7, labels: int = 10, n_positives: int = 5, k: int = 3, least: int = 50, most: int = 95, scale: int = 256, block: tuple[int, int] = (2048, 8192)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (ids divisible by `every`) and each of its
    n_positives nearest rows of the same label, the first k rows of other labels with least * positive <= 100 * negative <= most * positive.

    shift_every, labels: ids divisible by shift_every carry the next label of the ring. block: anchors and rows of a cell."""
    rows = usable_rows(df, id_col, vector, label)
    rows = rows.withColumn("label", F.coalesce(relabelled(F.col("label"), F.col("id"), shift_every, labels), F.col("label")))
    is_anchor = F.col("id") % every == 0
    rows = stash(rows, "vectors", n=F.count("*"), anchors=F.count_if(is_anchor))
    grid = tuple(max(1, -(-(n or 0) // size)) for n, size in zip((rows.facts["anchors"], rows.facts["n"]), block, strict=True))
    anchors = rows.where(is_anchor)
    found = _in_cells(anchors, rows, grid, partial(_find_positives, n=n_positives, scale=scale), "row long, positive_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "positive_id")
    found = stash(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives), "positives")
    own = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("p"))  # n_positives at most
    with_positives = anchors.join(own, "row").select("row", "id", "label", "vector", F.col("p.score").alias("scores"))
    cells = _in_cells(with_positives, rows, grid, partial(_find_negatives, k=k, least=least, most=most, scale=scale), "row long, j long, negative_id long, score long")
    first = Window.partitionBy("row", "j").orderBy(F.col("score").desc(), "negative_id")
    cells = cells.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = anchors.select("row", F.col("id").alias("anchor_id"))
    p = found.select("row", (F.col("place") - 1).cast("long").alias("j"), "positive_id", F.col("score").alias("positive_score")).join(names, "row")
    null = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
    return cells.join(p, ["row", "j"]).select("anchor_id", null("positive_id"), "rank", null("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY r, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (r, anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
