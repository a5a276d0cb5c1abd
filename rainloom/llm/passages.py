"""Repeated passages: hashing of lines, and of all windows of words for passages that begin and end within lines.

Lines (paragraphs) are normalised (Unicode lower case, single spaces), those of `line` words or more hashed to 128 bits, digests are grouped over all documents, and the
occurrence with the smallest id, then text, then offset, is kept; all others are removed.

Passages that documents share also begin and end anywhere. So a second kind of unit begins at every word and is the next `unit` words: no word is outside the units, and
what stands around a passage doesn't change the units within. They are hashed and grouped in the same way. Where every unit from one word to a later one is a repeat, these units are a
stretch, and stretches of at least `least` words are removed, with their offsets in the original text. So every run of `least` words or more that stands in a
document with a smaller id, or before in the same text, is removed to its last word; and of what is removed, every `unit` words in a row stand in one run of such a place, so that short phrases
of several documents, side by side, stay. Digests have 64 bits: a stretch takes `least - unit + 1` neighbours (three) that all are repeats, which chance doesn't give.

There are nearly as many windows as words, so they travel packed: each row of the shuffles holds the units of one range of digests (then of one chunk or some documents).
A digest that a text repeats is sent once for the text, and one that a chunk of CHUNK units repeats is sent once for the chunk, whose other occurrences wait for the answer. So a
passage that a third of all documents hold comes to the task of its digests once a chunk and not once a document. Ranges grow in number with the session's shuffle partitions.

Cases: null, empty and short texts have no units; a row without an id ranks behind all that have one, by the hash of its text, and its doc_id is null in the result; rows that
repeat an id are compared with each other by their texts, and rows that repeat both are treated alike (none is a copy of the other); ids lie below 2**62; an empty table
gives an empty result; other columns are not looked at, and kept by `remove_repeats`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import stash

TOKEN = re.compile(r"\S+")
#: Units (hits) that a task holds before it sends them on.
CHUNK = 1 << 20
#: Ids from here on stand for rows without one.
NO_ID = 1 << 62
PACKED = "bucket long, kind int, chunk long, n int, inner binary, outer binary"
#: Kinds of packed rows: units of a range of digests (their positions doubled, odd if others of their chunk wait), units of a chunk that wait, answers for them, units that a text repeats, and hits.
UNIT, WAITING, ANSWER, WITHIN, HIT = range(5)
#: Packed rows that a task passes on together at most, and bytes of them.
PASSED, PASSED_BYTES = 1024, 1 << 24


class _Hashes(dict):
    """64-bit hashes of words, each computed once while it stays in."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_hashes = _Hashes()


def _both(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Digests of windows put together from windows of `size` words and those that follow them."""
    right = right[size:]
    out = left[: len(right)] * np.uint64(xxhash.xxh3_64_intdigest(b"size %d" % size) | 1) + right[: len(left)]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def digests(text: str | None, unit: int) -> np.ndarray:
    """The digest of the `unit` words from each word on, from those of 1, 2, 4, … words."""
    words = (text or "").lower().split()
    if len(words) < unit:
        return np.empty(0, np.uint64)
    part = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size, out, done = 1, None, 0
    while True:
        if unit & size:
            out, done = part if out is None else _both(out, part, done), done + size
        if done == unit:
            return out
        part, size = _both(part, part, size), 2 * size


def units(text: str | None, unit: int) -> list[tuple[int, int, int, int, int]]:
    """(digest, first word, behind the last word, start, end) of every unit; words by number, start and end as character offsets."""
    spans = [m.span() for m in TOKEN.finditer(text or "")]
    return [(d, b, b + unit, spans[b][0], spans[b + unit - 1][1]) for b, d in enumerate(digests(text, unit).tolist())]


def _part(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 31)


def _planes(*columns: np.ndarray) -> bytes:
    """Columns byte by byte: the lowest bytes of all rows, then the next ones."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def _column(data: bytes, start: int, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, start).reshape(size, n).T).view(kind).ravel()


def _packed(bucket: np.ndarray, kind: int, doc: np.ndarray, part: np.ndarray, pos: np.ndarray, value: np.ndarray, chunk: int = 0) -> pd.DataFrame:
    """One row per bucket: its documents (the first, then differences) and positions, ascending, a bit where a new text begins, the part of each of these, and values. Digests
    (unsigned values) and their parts don't compress and stay apart."""
    # order within a bucket only serves compression
    order = np.argsort(bucket, kind="stable") if (doc[1:] >= doc[:-1]).all() else np.lexsort((pos, doc, bucket))
    bucket, doc, part, pos, value = bucket[order], doc[order], part[order], pos[order], value[order]
    at = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    step = np.diff(doc, prepend=0)
    new = np.zeros(len(doc), bool)
    new[_heads(bucket, doc, part)] = True
    rows = []
    for a, b in zip(at, at[1:], strict=False):
        step[a] = doc[a]
        c = slice(a, b)
        inner, outer = _planes(step[c], pos[c]) + np.packbits(new[c]).tobytes(), _planes(part[c][new[c]], value[c])
        if value.dtype != np.uint64:
            inner, outer = inner + outer, b""
        rows.append((int(bucket[a]), kind, chunk, b - a, zlib.compress(inner, 1), outer))
    return pd.DataFrame(rows, columns=["bucket", "kind", "chunk", "n", "inner", "outer"])


def _unpacked(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, part, pos and value (int64, also of digests) of packed rows."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64))]
    for r in rows:
        inner, n = zlib.decompress(r.inner), r.n
        doc, pos = np.cumsum(_column(inner, 0, n, "<i8")), _column(inner, 8 * n, n, "<i4")
        text = np.cumsum(np.unpackbits(np.frombuffer(inner, np.uint8, (n + 7) // 8, 12 * n), count=n), dtype=np.int64)
        texts = int(text[-1])
        data, start = (r.outer, 0) if r.outer else (inner, 12 * n + (n + 7) // 8)
        part = _column(data, start, texts, "<i4")[text - 1]
        out.append((doc, part, pos, _column(data, start + 4 * texts, n, "<i8")))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """The rows of each bucket, of batches sorted by bucket."""
    rows: list = []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if rows and rows[0].bucket != r.bucket:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _rows(packed: list) -> pd.DataFrame:
    return pd.DataFrame(packed, columns=["bucket", "kind", "chunk", "n", "inner", "outer"])


def _many(packed: list) -> bool:
    return len(packed) >= PASSED or sum(len(r.inner) + len(r.outer) for r in packed) >= PASSED_BYTES


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([np.diff(c) != 0 for c in columns])]))


def ranked(id_: Column, text: Column) -> Column:
    """The id by which rows rank: their own, or one behind all others that the text gives."""
    return F.coalesce(id_.cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))


def line_repeats(x: DataFrame, line: int) -> DataFrame:
    """(doc_id, part, b, e, first_doc_id): the repeated lines of x (doc_id, text), from word b up to word e."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                part, at = None, 0
                for one in text.split("\n"):
                    words = one.lower().split()
                    if len(words) >= line:
                        part = _part(text) if part is None else part
                        rows.append((i, part, at, at + len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
                    at += len(words)
            yield pd.DataFrame(rows, columns=["doc_id", "part", "b", "e", "digest"])

    lines = stash(x.mapInPandas(cut, "doc_id long, part int, b int, e int, digest binary"), "lines")
    place = F.struct("doc_id", "part", "b")
    firsts = lines.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first")
    # Read from tables on both sides, so that a line that very many documents hold can be split over tasks.
    return lines.join(stash(firsts, "line-firsts"), "digest").where(place != F.col("first")).select("doc_id", "part", "b", "e", F.col("first.doc_id").alias("first_doc_id"))


def _stretches(doc: int, part: int, pos: np.ndarray, first: np.ndarray, unit: int, least: int) -> list[tuple]:
    """Stretches of one text as (doc, part, first word, behind the last word, first_doc_id), from its repeated units in order of position."""
    new = np.flatnonzero(np.diff(pos) > 1) + 1
    begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(pos)]]) - 1
    b, e = pos[begin], pos[end] + unit
    return [(doc, part, int(b[k]), int(e[k]), int(first[begin[k]])) for k in np.flatnonzero(e - b >= least)]


def window_repeats(x: DataFrame, unit: int, least: int, chunk: int) -> DataFrame:
    """(doc_id, part, b, e, first_doc_id): the repeated stretches of x (doc_id, text), from word b up to word e."""
    partitions = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges, doc_buckets = max(2048, 8 * partitions), max(512, 2 * partitions)

    def within_bucket(doc: np.ndarray) -> np.ndarray:
        return -1 - _doc_bucket(doc, doc_buckets)  # below 0: of documents, not of chunks

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunk by chunk: the first unit of each digest by range of digests, the others that wait for its answer, and by document those that a text repeats, with the place of the first."""
        held, n, made = [], 0, TaskContext.get().partitionId() << 32

        def sent() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda h: h[:2])  # by document and text, so that the first of equal digests is the first that ranks
            doc, part, size = (np.array([h[k] for h in held], np.int64) for k in range(3))
            doc, part = np.repeat(doc, size), np.repeat(part, size).astype(np.int32)
            pos, digest, ref = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
            if not (once := ref < 0).all():
                again = ~once
                yield _packed(within_bucket(doc[again]), WITHIN, doc[again], part[again], pos[again], ref[again].astype(np.int64))
            doc, part, pos, digest = doc[once], part[once], pos[once], digest[once]
            order = np.argsort(digest, kind="stable")
            head = _heads(digest[order])
            several = np.zeros(len(order), np.int32)
            several[order[head]] = np.diff(head, append=len(order)) > 1
            first = np.sort(order[head])
            rest = np.ones(len(order), bool)
            rest[first] = False
            yield _packed((digest[first] >> np.uint64(32)).astype(np.int64) * ranges >> 32, UNIT, doc[first], part[first], pos[first] * np.int32(2) + several[first], digest[first], made)
            if rest.any():
                yield _packed(np.full(int(rest.sum()), made), WAITING, doc[rest], part[rest], pos[rest], digest[rest], made)

        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                d = digests(text, unit)
                if not len(d):
                    continue
                _, first, back = np.unique(d, return_index=True, return_inverse=True)
                at = np.arange(len(d))
                ref = np.where(first[back] == at, -1, first[back]).astype(np.int32)
                held.append((i, _part(text), len(d), at.astype(np.int32), d, ref))
                n += len(d)
                if n >= chunk:
                    yield from sent()
                    held, n, made = [], 0, made + 1
        if held:
            yield from sent()

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each range of digests, the units that aren't the first of their kind, by document, with the id of the first; and the answers for chunks. Other rows pass."""
        hits, answers, passing, n = [], [], [], 0

        def sent() -> Iterator[pd.DataFrame]:
            doc, part, pos, first = (np.concatenate([h[k] for h in hits]) for k in range(4))
            yield _packed(within_bucket(doc), HIT, doc, part, pos, first)
            chunks, first, digest = (np.concatenate([h[k] for h in answers]) for k in range(3))
            zero = np.zeros(len(first), np.int32)
            yield _packed(chunks, ANSWER, first, zero, zero, digest.view(np.uint64))

        for rows in _by_bucket(batches):
            passing += [r for r in rows if r.kind != UNIT]
            if _many(passing):
                yield _rows(passing)
                passing = []
            rows = [r for r in rows if r.kind == UNIT]
            doc, part, pos, digest = _unpacked(rows)
            if not len(doc):
                continue
            order = np.lexsort((part, doc, digest))
            head = _heads(digest[order])
            count = np.diff(head, append=len(order))
            first, first_part = np.empty_like(doc), np.empty_like(part)
            first[order], first_part[order] = np.repeat(doc[order[head]], count), np.repeat(part[order[head]], count)
            asked = pos % 2 == 1
            answers.append((np.repeat([r.chunk for r in rows], [r.n for r in rows])[asked], first[asked], digest[asked]))
            hit = (first != doc) | (first_part != part)
            hits.append((doc[hit], part[hit], pos[hit] // 2, first[hit]))
            n += int(hit.sum()) + int(asked.sum())
            if n >= CHUNK:
                yield from sent()
                hits, answers, n = [], [], 0
        if hits:
            yield from sent()
        if passing:
            yield _rows(passing)

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The units that waited in a chunk, by document, as the hits that they are. Other rows pass."""
        passing: list = []
        for rows in _by_bucket(batches):
            if rows[0].bucket < 0:
                passing += rows
                if _many(passing):
                    yield _rows(passing)
                    passing = []
                continue
            doc, part, pos, digest = _unpacked([r for r in rows if r.kind == WAITING])
            first, _, _, known = _unpacked([r for r in rows if r.kind == ANSWER])
            order = np.argsort(known)
            at = order[np.searchsorted(known, digest, sorter=order)]
            yield _packed(within_bucket(doc), HIT, doc, part, pos, first[at])
        if passing:
            yield _rows(passing)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _by_bucket(batches):
            across, within = (_unpacked([r for r in rows if r.kind == k]) for k in (HIT, WITHIN))
            doc, part, pos = (np.concatenate([across[k], within[k]]) for k in range(3))
            # A unit repeated within its text has the first occurrence that the text's first unit of that kind has.
            ref = np.concatenate([across[2], within[3].astype(np.int32)])
            value = np.concatenate([across[3], within[0]])
            own = np.concatenate([np.zeros(len(across[0]), bool), np.ones(len(within[0]), bool)])
            order = np.lexsort((own, ref, part, doc))
            head = _heads(doc[order], part[order], ref[order])
            first = np.empty(len(order), np.int64)
            first[order] = np.repeat(value[order[head]], np.diff(head, append=len(order)))
            order = np.lexsort((pos, part, doc))
            d, p, at, first = doc[order], part[order], pos[order], first[order]
            edge = [*_heads(d, p).tolist(), len(d)]
            out = [s for a, b in zip(edge, edge[1:], strict=False) for s in _stretches(int(d[a]), int(p[a]), at[a:b], first[a:b], unit, least)]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "part", "b", "e", "first_doc_id"])

    sorted_by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    sent = x.mapInPandas(cut, PACKED)
    for step in (met, answered):
        sent = sorted_by_bucket(sent).mapInPandas(step, PACKED)
    return sorted_by_bucket(sent).mapInPandas(merged, "doc_id long, part int, b int, e int, first_doc_id long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 38, least: int = 40, line: int = 16, chunk: int = CHUNK) -> DataFrame:
    """One row per removed stretch: doc_id, part (hash of the text, for rows that repeat an id), start, end, n_words, first_doc_id (which keeps the first unit's first occurrence)."""
    found = _repeats(docs, id_col, text_col, unit, least, line, chunk)
    no_id = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return found.select(no_id("doc_id"), "part", "start", "end", "n_words", no_id("first_doc_id"))


def _repeats(docs: DataFrame, id_col: str, text_col: str, unit: int, least: int, line: int, chunk: int) -> DataFrame:
    text = docs[text_col]
    x = docs.select(ranked(docs[id_col], text).alias("doc_id"), text.alias("text")).where("text is not null")

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where the words of each text lie: lengths of the gaps before them and of the words, much smaller than the text."""
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                ends = np.fromiter((e for m in TOKEN.finditer(text) for e in m.span()), np.int64)
                if len(ends) >= 2 * min(least, line):
                    rows.append((i, _part(text), zlib.compress(_planes(np.diff(ends, prepend=0)), 1)))
            yield pd.DataFrame(rows, columns=["doc_id", "part", "ends"])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Word numbers as character offsets; what overlaps or touches is one stretch, with the first document of its first part."""
        for batch in batches:
            rows = []
            for i, part, data, cuts in zip(batch["doc_id"], batch["part"], batch["ends"], batch["cuts"], strict=True):
                data = zlib.decompress(data)
                ends = np.cumsum(_column(data, 0, len(data) // 8, "<i8"))
                joined: list[list[int]] = []
                for b, e, first in sorted((c["b"], c["e"], c["first_doc_id"]) for c in cuts):
                    if joined and b <= joined[-1][1]:
                        joined[-1][1] = max(e, joined[-1][1])
                    else:
                        joined.append([b, e, first])
                rows += [(i, part, int(ends[2 * b]), int(ends[2 * e - 1]), e - b, first) for b, e, first in joined]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "start", "end", "n_words", "first_doc_id"])

    found = window_repeats(x, unit, least, chunk).unionByName(line_repeats(x, line))
    cuts = found.groupBy("doc_id", "part").agg(F.collect_list(F.struct("b", "e", "first_doc_id")).alias("cuts"))  # of one text
    texts = x.mapInPandas(lengths, "doc_id long, part int, ends binary").join(cuts, ["doc_id", "part"])
    return texts.mapInPandas(placed, "doc_id long, part int, start long, end long, n_words long, first_doc_id long").distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed", unit: int = 38, least: int = 40, line: int = 16) -> DataFrame:
    """docs with the repeats cut out of text_col; removed_col holds (start, end) of each in the original text. If docs has such a column, the new one's name gets underscores until it is unused."""
    while removed_col in docs.columns:
        removed_col += "_"
    cut = _repeats(docs, id_col, text_col, unit, least, line, CHUNK).groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    part = F.pandas_udf(lambda t: pd.Series([None if x is None else _part(x) for x in t], dtype="Int32"), "int")
    x = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"), ranked(docs[id_col], docs[text_col]).alias("doc_id"), part(docs[text_col]).alias("part"))
    y = x.join(cut, ["doc_id", "part"], "left")

    # what lies between the end of one stretch and the start of the next
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("removed.end"))
    ends = F.concat(F.col("removed.start"), F.array(F.length("text").cast("long")))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return y.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns], F.coalesce("removed", none).alias(removed_col))
