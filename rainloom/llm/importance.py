"""Importance resampling towards a target: documents drawn by how much likelier their hashed words are in the target than in the raw corpus.

Two passes over Arrow batches. The first turns each partition into one vector of bucket counts (np.bincount), and treeReduce adds the
vectors. The second gathers each feature's gain from the broadcast vector (one number a bucket, so its size is fixed) and sums them by
document (np.bincount with weights; whole numbers, so the sums are exact). Scores take a hash of the id as their random part (Gumbel), and
the highest ones are drawn: which scores lie above the cut follows from the counts of scores, which are whole numbers within a range fixed by
the size of gains (under 250,000 values, however many documents there are); ranks come from ranges of (score, id), the places within a range
behind the sizes of the ranges before.

Cases: a null or empty text has no features, weight 0, and isn't drawn, as isn't any text of fewer than `least` words. A null id hashes as
an empty one and loses ties. Rows count as rows: repeated ones each have a place. An empty target or corpus counts as zeros. Other
columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.llm.common import stash

#: Bytes that words are made of: digits, letters (upper-case ones become lower-case) and all of what isn't ASCII; the rest become spaces.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Distinct features whose buckets a worker remembers before it begins anew.
REMEMBERED = 500_000
#: Bytes of text that are taken apart at once (one text at least).
PORTION = 4 << 20


class _Buckets(dict):
    """The bucket of a feature: its CRC-32 modulo their number."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % self.buckets
        return b


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts as UTF-8, null as empty, some at a time."""
    part, size = [], 0
    for text in column.cast(pa.binary()):
        part.append(text.as_py() or b"")
        size += len(part[-1])
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def _features(texts: list[bytes], longest: int, known: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, one text behind the other; number of features, and of words, of each text."""
    split = [t.translate(WORD_BYTES).split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    if longest == 1:
        return np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, n_words.sum()), n_words, n_words
    runs = [[w if k == 1 else b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i, w in enumerate(words[: len(words) - k + 1])] for words in split]
    n = np.fromiter(map(len, runs), np.int64, len(runs))
    return np.fromiter(map(known.__getitem__, chain.from_iterable(runs)), np.int64, n.sum()), n, n_words


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """How many features of all texts are in each bucket. One vector a partition, merged in a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for part in _texts(batch.column(0)):
                total += np.bincount(_features(part, longest, known)[0], minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = df.select(F.col(text_col).alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    none = df.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add, depth=3)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, 1000 times the logarithm of its smoothed share in the target over that in the raw corpus, rounded down."""
    k, whole, wanted = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (whole + k) / ((s + 1) * (wanted + k)))) for s, t in zip(raw.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """doc_id, n_features, n_words, weight: the mean gain of a document's features, rounded down."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = _Buckets(buckets), shared.value.astype(float)
        for batch in batches:
            n_all, words_all, weight_all = [], [], []
            for part in _texts(batch.column(1)):
                found, n, n_words = _features(part, longest, known)
                total = np.bincount(np.repeat(np.arange(len(part)), n), weights=of[found], minlength=len(part)).astype(np.int64)
                n_all, words_all, weight_all = [*n_all, n], [*words_all, n_words], [*weight_all, total // np.maximum(n, 1)]
            if n_all:
                yield pa.record_batch([batch.column(0), *(pa.array(np.concatenate(v)) for v in (n_all, words_all, weight_all))], ["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, rounded down, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(df: DataFrame) -> DataFrame:
    """df with rank 1, 2, … by score from the highest, then by doc_id (null last), then row: ranges of that order, each sorted by itself."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = stash(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "drawn")
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = x.groupBy("part").agg(F.count("*").alias("size")).select("part", before.alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return x.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + place).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 10, least: int = 20, seed: int = 2024, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """A row per document: doc_id, n_features, weight, score, rank (of the floor(percent * N / 100) highest scores among the N documents of
    `least` words or more; else null), n_words."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    x = weigh(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    x = stash(x, "weights", n=F.count_if(F.col("n_words") >= least))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    wanted, above, cut = percent * (x.facts["n"] or 0) // 100, 0, None
    for score, n in sorted(x.where(F.col("n_words") >= least).groupBy("score").count().collect(), reverse=True) if wanted else []:
        if above >= wanted:
            break
        above, cut = above + n, score
    none = F.lit(None).cast("long")
    if cut is None:
        return x.withColumn("rank", none).select(columns)
    high = (F.col("n_words") >= least) & (F.col("score") >= cut)
    drawn = _ranked(x.where(high)).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return x.where(~high).withColumn("rank", none).select(columns).unionByName(drawn.select(columns))


SQL = r"""
WITH RECURSIVE byte_table AS (
  SELECT 0 AS step, b::BIGINT AS b, b::BIGINT AS c FROM range(256) r(b)
  UNION ALL
  SELECT step + 1, b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM byte_table WHERE step < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM byte_table WHERE step = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
raw AS (SELECT r, unnest(w) AS word FROM d),
seen AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM raw UNION SELECT word FROM b)),
bucket AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x)::BIGINT, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS k FROM seen, tab),
s AS (SELECT k, count(*) AS s FROM raw JOIN bucket USING (word) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN bucket USING (word) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (k)),
weights AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM raw JOIN bucket USING (word) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank, n_features AS n_words FROM placed
"""
