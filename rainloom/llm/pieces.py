"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says and taken apart into characters; an agenda holds the adjacent pairs that make a piece, the best
score first and of equal scores the leftmost; each pair taken from it becomes one symbol and offers its new neighbours. Characters that
are no piece become their bytes' pieces. Where no piece of the vocabulary has a mark of white space (or a line end) behind another
character, no merge reaches over that place, so the stretches between such places are encoded by themselves, and a worker remembers short ones.

Every batch is checked against the sentencepiece library: each stretch that a worker encodes, in the batch that brings it (or, with whole=True and for
vocabularies that hold line ends, each text anew). `agrees` says whether a text's own ids are the library's. Where they aren't (models with user-defined
or unused pieces, which the agenda doesn't know), the library's ids are returned. The ids are decoded by the library.

Cases: a null text counts as empty (the end id alone); rows are encoded row by row, repeated or not; strings such as </s> inside texts are
ordinary characters, as the library has it; a text of any length is encoded whole, its agenda taking memory in proportion to its longest
stretch. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How SentencePiece writes a space.
MARK = "▁"
#: Stretches of so many characters at most are remembered, so many of them in a generation.
SHORT, REMEMBERED = 48, 300_000
#: So many short stretches of like lengths go through one agenda.
TOGETHER = 4096
#: The rank of a pair that makes no piece.
NEVER = (1 << 31) - 1
#: Characters that are encoded at once (one text at least).
PORTION = 1 << 20


class Merger:
    """Ids of texts under one model. Short stretches are remembered, two generations of them, of which the older one goes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))}
        # symbols: the pieces and the characters in them; one more stands for all other characters
        names = list(dict.fromkeys([*pieces, *chain.from_iterable(pieces)]))
        number = {name: i for i, name in enumerate(names)}
        self.other, self.base = len(names), len(names) + 1
        self.char = {c: i for c, i in number.items() if len(c) == 1}
        self.ids = [pieces.get(name, -1) for name in names] + [-1]
        scores = sorted({-sp.get_score(i) for i in pieces.values()})
        place = {s: i for i, s in enumerate(scores)}
        self.rank = [place[-sp.get_score(i)] if i >= 0 else -1 for i in self.ids]
        self.pairs = {number[p[:k]] * self.base + number[p[k:]]: number[p] for p in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        # the same as arrays: symbols by code point, sorted pairs, and by symbol (none: the last) rank and id
        self.symbol_of = np.full(0x110000, self.other, np.int64)
        self.symbol_of[[ord(c) for c in self.char]] = list(self.char.values())
        keys = np.array(list(self.pairs), np.int64)
        self.pair_keys, self.pair_made = np.sort(keys), np.array(list(self.pairs.values()), np.int64)[keys.argsort()]
        self.rank_of, self.id_of = np.array([*self.rank, NEVER], np.int32), np.array(self.ids)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(sp.is_byte, range(sp.vocab_size()))) else None
        self.doubtful: set[str] = set()
        # a stretch: marks and what follows up to the next mark; a line end that no longer piece holds stands by itself
        stop = "" if any(MARK in p.lstrip(MARK) for p in pieces) else MARK
        lone = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
        self.head = sp.encode("\n") if stop and lone else None
        self.line = sp.encode("\n\n")[len(self.head) :] if self.head else []
        inner = f"[^{stop}{lone}]+" if stop + lone else r"(?s:.+)"
        self.stretches = re.compile((f"{stop}*{inner}|{stop}+" if stop else inner) + (f"|{lone}" if lone else "")).findall

    def _merge(self, text: str) -> list[int]:
        pairs, rank, base = self.pairs, self.rank, self.base
        symbols = [self.char.get(c, self.other) for c in text]
        n = len(symbols)
        # an entry: the place of the pair's score, then the place of its left symbol
        agenda = [rank[made] << 32 | i for i in range(n - 1) if (made := pairs.get(symbols[i] * base + symbols[i + 1])) is not None]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            entry = heapq.heappop(agenda)
            a = entry & 0xFFFFFFFF
            if symbols[a] < 0 or (b := after[a]) == n:
                continue
            made = pairs.get(symbols[a] * base + symbols[b])
            if made is None or rank[made] != entry >> 32:
                continue  # one of the two has merged meanwhile
            symbols[a], symbols[b] = made, -1
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                if (more := pairs.get(made * base + symbols[c])) is not None:
                    heapq.heappush(agenda, rank[more] << 32 | a)
            c = before[a]
            if c >= 0 and (more := pairs.get(symbols[c] * base + made)) is not None:
                heapq.heappush(agenda, rank[more] << 32 | c)
        out: list[int] = []
        for i, s in enumerate(symbols):
            if s >= 0:
                if (id_ := self.ids[s]) >= 0:
                    out.append(id_)
                else:
                    out += [self.bytes[b] for b in text[i].encode()] if self.bytes else [self.library.unk_id()]
        return out

    def _made(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The symbols that pairs make, -1 for none."""
        key = x * self.base + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], -1)

    def _merge_many(self, texts: list[str]) -> list[tuple[int, ...]]:
        """_merge of many short texts at once: a row of the agenda is a text's, and every turn takes each row's first pair."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        width, everyone = int(lens.max()), np.arange(len(texts))
        column = np.arange(width + 1)
        within = column < lens[:, None]
        symbols = np.full(within.shape, self.other)
        symbols[within] = self.symbol_of[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        after = np.where(column + 1 < lens[:, None], column + 1, width)  # column `width` stands for the end
        before = np.broadcast_to(column - 1, within.shape).copy()
        made = np.full(within.shape, -1)
        pair = within[:, 1:]
        made[:, :-1][pair] = self._made(symbols[:, :-1][pair], symbols[:, 1:][pair])
        agenda = self.rank_of[made]

        def offer(rows: np.ndarray, a: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            made[rows, a] = found = self._made(x, y)
            agenda[rows, a] = self.rank_of[found]

        rows = everyone
        while len(rows):
            a = agenda[rows].argmin(1)
            more = agenda[rows, a] < NEVER
            rows, a = rows[more], a[more]
            one, b = made[rows, a], after[rows, a]
            c = after[rows, b]
            symbols[rows, a], symbols[rows, b], agenda[rows, b] = one, -1, NEVER
            after[rows, a], before[rows, c] = c, a
            offer(rows, a, one, symbols[rows, c])
            p = before[rows, a]
            some = p >= 0
            offer(rows[some], p[some], symbols[rows[some], p[some]], one[some])
            symbols[rows, width] = self.other
        left = within & (symbols >= 0)
        ids, ends = self.id_of[symbols[left]], left.sum(1).cumsum()
        odd = np.zeros(len(texts), bool)
        odd[np.repeat(everyone, left.sum(1))[ids < 0]] = True  # characters that are no piece
        flat, starts = ids.tolist(), [0, *ends.tolist()]
        return [tuple(self._merge(t)) if o else tuple(flat[i:j]) for t, o, i, j in zip(texts, odd.tolist(), starts, starts[1:], strict=False)]

    def _check(self, stretches: list[str]) -> None:
        """Hold the ids of new stretches against the library's, a line each; those that differ are doubtful from now on."""
        for i in range(0, len(stretches), TOGETHER):
            some = stretches[i : i + TOGETHER]
            want = self.library.encode("".join(f"\n{s}" for s in some).replace(MARK, " "))
            got = list(self.head[: len(self.head) - len(self.line)])
            for s in some:
                got += self.line
                got += self.memo[s]
            if got != want:
                self.doubtful.update(s for s in some if [*self.head, *self.memo[s]] != self.library.encode(f"\n{s}".replace(MARK, " ")))

    def agreeing(self, texts: list[str], ids: list[list[int]], whole: bool) -> list[list[int] | None]:
        """For each text None where its ids are the library's, else what the library gives."""
        if self.head and not whole and not self.doubtful:
            return [None] * len(texts)
        at = range(len(texts)) if whole or not self.head else [i for i, t in enumerate(texts) if not self.doubtful.isdisjoint(self.stretches(self.library.normalize(t)))]
        out: list[list[int] | None] = [None] * len(texts)
        for i, want in zip(at, self.library.encode([texts[i] for i in at], num_threads=1), strict=True):
            if want != ids[i]:
                out[i] = want
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        cuts = [self.stretches(self.library.normalize(t)) for t in texts]
        memo, old = self.memo, self.old
        new = set(chain.from_iterable(cuts)).difference(memo)
        memo.update((s, old[s]) for s in new & old.keys())
        short = sorted((s for s in new.difference(memo) if len(s) <= SHORT), key=len)
        long = [s for s in new if len(s) > SHORT]
        for i in range(0, len(short), TOGETHER):
            memo.update(zip(short[i : i + TOGETHER], self._merge_many(short[i : i + TOGETHER]), strict=True))
        memo.update((s, tuple(self._merge(s))) for s in long)
        if self.head:
            self._check(short + long)
        out = [list(chain.from_iterable(map(memo.__getitem__, cut))) for cut in cuts]
        for s in long:
            del memo[s]
        if len(memo) > REMEMBERED:
            self.memo, self.old = {}, memo
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def _portions(column: pa.Array) -> Iterator[list[str]]:
    part, size = [], 0
    for text in column:
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, whole: bool = False) -> DataFrame:
    """A row per document: doc_id, ids, decoded (what the library makes of the ids), agrees. whole: check every text, not every new stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(model)
        sp, tail = own.library, [own.library.eos_id()] if end else []
        for batch in batches:
            at = 0
            for texts in _portions(batch.column(1)):
                got = own.encode_all(texts)
                other = own.agreeing(texts, got, whole)
                agrees = [o is None for o in other]
                ids = [(a if o is None else o) + tail for a, o in zip(got, other, strict=True)]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(sp.decode(ids, num_threads=1), pa.string()), pa.array(agrees)], ["doc_id", "ids", "decoded", "agrees"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string, agrees boolean")


def encoding_report(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees: sizes and digests of what encode_documents gives."""
    x = encode_documents(docs, model, id_col, text_col)
    digest = F.sha2(F.array_join("ids", " "), 256)
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
