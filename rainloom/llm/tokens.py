"""Token counts of whole texts, huge ones in overlapping chunks that are spliced again.

A document longer than one chunk is cut into chunks that overlap, each chunk is encoded with offsets as a row of its
own (so one huge document spreads over many tasks), and neighbours are spliced where both encodings agree: at a
position between a character that isn't white space and a single space before a word, where both have a token start
and the same ids on either side. No byte-level pre-token reaches over such a position whatever stands around it,
so tokens left of it don't depend on the right chunk and the reverse. Junctions without such a position get their
document encoded again with wider overlaps, until one chunk holds the whole text.

For texts of one chunk the same fact saves work: what lies between stable positions is encoded by the library once per
worker and remembered.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows of one id are counted row by row; strings of special tokens
inside texts are what the library makes of them by default.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import stash

#: Where white space meets a space: there a position before a space need not be stable.
UNSTABLE = re.compile(r"\s | \s|^ | $")
#: A stable position: behind it a single space and a letter or digit.
STABLE = re.compile(r"(?<=\S) (?=[^\W_])")
#: Distinct stretches that a worker remembers before it begins anew.
REMEMBERED = 300_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class _Counter:
    """Token counts of texts of one chunk."""

    def __init__(self, path: str) -> None:
        self.t, self.memo = tokenizer(path), {}

    def of(self, texts: list[str]) -> list[int]:
        memo, split = self.memo, []
        for text in texts:
            split.append([text] if UNSTABLE.search(text) else [p if not i else " " + p for i, p in enumerate(text.split(" "))] if text else [])
        if new := list({p for parts in split for p in parts} - memo.keys()):
            if len(memo) + len(new) > REMEMBERED:
                memo.clear()
                new = list({p for parts in split for p in parts})
            for i in range(0, len(new), 256):
                for p, e in zip(new[i : i + 256], self.t.encode_batch_fast(new[i : i + 256], add_special_tokens=False), strict=True):
                    memo[p] = len(e)
        out = [sum(map(memo.__getitem__, parts)) for parts in split]
        for parts in split:  # a whole text isn't a stretch that comes again
            if len(parts) == 1:
                memo.pop(parts[0], None)
        return out


def _chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    n = max(1, -(-(len(text) - overlap) // chunk))
    for i in range(n):
        yield i, i * chunk, text[i * chunk : (i + 1) * chunk + overlap if i < n - 1 else len(text)]


def _candidates(piece: str, start: int, enc, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """(position in the text, index of the token that starts there, ids around it) of the stable positions of piece[lo:hi]."""
    out, ids = [], enc.ids
    for m in STABLE.finditer(piece, max(0, lo), hi):
        i = enc.char_to_token(m.start())
        if i is not None and 2 <= i <= len(ids) - 3 and enc.token_to_chars(i)[0] == m.start() and enc.token_to_chars(i - 1)[1] <= m.start():
            out.append((start + m.start(), i, " ".join(map(str, ids[i - 2 : i + 2]))))
    return out


def _spliced(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of long documents (key, text); n_tokens is null where a junction found no common boundary."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for key, text in zip(x["key"], x["text"], strict=True):
                yield pd.DataFrame([(key, i, start, piece) for i, start, piece in _chunks(text, chunk, overlap)], columns=["key", "i", "start", "piece"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for x in batches:
            rows = []
            for key, i, start, piece in zip(x["key"], x["i"], x["start"], x["piece"], strict=True):
                enc = t.encode(piece, add_special_tokens=False)
                head = _candidates(piece, start, enc, 0, overlap) if i else []
                tail = _candidates(piece, start, enc, chunk, len(piece))
                rows += [(key, i - 1, True, len(enc.ids), *c) for c in head] + [(key, i, False, len(enc.ids), *c) for c in tail] + [(key, i, None, len(enc.ids), None, None, None)]
            yield pd.DataFrame(rows, columns=["key", "j", "is_head", "n", "at", "token", "ids"]).astype({"is_head": "boolean", "at": "Int64", "token": "Int64"})

    parts = docs.sparkSession.sparkContext.defaultParallelism * 4
    pieces = docs.mapInPandas(cut, "key string, i long, start long, piece string").repartition(parts, "key", "i")
    out = stash(pieces.mapInPandas(encode, "key string, j long, is_head boolean, n long, at long, token long, ids string"), "token-chunks")
    tail, head = out.where("not is_head"), out.where("is_head")
    common = tail.alias("a").join(head.alias("b"), ["key", "j", "at", "ids"]).groupBy("key", "j").agg(F.min(F.struct("at", (F.col("a.n") - F.col("a.token") + F.col("b.token")).alias("twice"))).alias("s"))
    cut_off = common.groupBy("key").agg(F.count("*").alias("junctions"), F.sum("s.twice").alias("twice"))
    total = out.where("is_head is null").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("chunks"))
    none = F.lit(0)
    return total.join(cut_off, "key", "left").select("key", F.when(F.coalesce("junctions", none) == F.col("chunks") - 1, F.col("n") - F.coalesce("twice", none)).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = 65536, overlap: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). chunk and overlap count characters."""
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be positive and at most the chunk")
    x = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    long = F.length("text") > chunk + overlap

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _Counter(tokenizer_path)
        for x in batches:
            counts = []
            for i in range(0, len(x), 512):
                counts += counter.of(x["text"].iloc[i : i + 512].tolist())
            yield pd.DataFrame({"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], "n_tokens": counts})

    short = x.where(~long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")

    # A long text is known by its digest: equal texts are encoded once, repeated ids keep their rows.
    huge = x.where(long).withColumn("key", F.sha2("text", 256))
    rows = huge.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key")
    texts, done, wide = huge.select("key", "text").dropDuplicates(["key"]), None, overlap
    while True:
        got = stash(_spliced(texts, tokenizer_path, max(chunk, wide), wide), "token-counts")
        done = got if done is None else done.unionByName(got)
        left = got.where("n_tokens is null").select("key")
        if left.isEmpty():
            break
        texts, wide = texts.join(left, "key", "left_semi"), wide * 8
    long_counts = rows.join(done.where("n_tokens is not null"), "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long_counts).withColumn("over_limit", F.col("n_tokens") > limit)
