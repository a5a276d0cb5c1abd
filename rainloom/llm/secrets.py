"""Secret scans by a recursive decoding worklist.

A text is scanned for three kinds of secrets. Encoded stretches of it (URL escapes, Unicode escapes, UTF-16, base64, and zlib
or gzip data inside base64) are decoded into further layers, each of which is scanned and searched for encoded
stretches in turn, until no new layer comes up. Layers seen before are not scanned again, so cycles end. Every position of a layer
keeps the span of the original text from which it was decoded; findings are reported as spans of the original.

Escapes are decoded in place over the whole layer, so what stands around them stays; those that aren't UTF-8 stay as they are. Escapes of an escape's own first
character (%252525…) are unwrapped in one step. A run of base64 is decoded from each of its first four characters on, as what stands before the code (a path, a
prefix with a mark that base64 has too) may belong to the run; base64 wrapped over lines of one length is joined. Compressed data may begin at any four characters of
a run. It is inflated to its end, as often as it is compressed, and scanned piece by piece, so that a worker holds a piece and not the whole: data within
compressed data is followed to any depth as long as it has `most` bytes or fewer; of larger ones DEEPEST are inflated together, and what lies deeper is marked `partial`.
Bytes that aren't text are scanned as far as they are. UTF-16 is decoded where it is ASCII.

Work is in proportion to the text: every pattern begins at the head of a run or looks back at one, and a layer is smaller than the one it comes from.

Cases: a null text counts as empty; an empty text has no spans; repeated rows give equal results; other columns
of the input are not looked at.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

URL_BYTES = re.compile(r"(?:%(?:25)*+[0-9A-Fa-f]{2})++")
URL_BYTE = re.compile(r"%(?:25)*+([0-9A-Fa-f]{2})")
#: Well-formed UTF-8.
UTF8 = re.compile(rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})++")
UNICODE_ESCAPE = re.compile(r"\\(?:u005[Cc]|x5[Cc]|u\{0{0,4}5[Cc]\}|U0000005[Cc])*+(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8}))")
#: ASCII in UTF-16: the zero byte before each character, or behind it.
UTF16 = re.compile(r"(?:\x00[\x01-\x7f]){6,}+(?!\x00)|(?:[\x01-\x7f]\x00){6,}+")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Two lines or more that base64 may be wrapped over.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Characters of inflated text scanned at a time, and those looked at again with the next piece at least.
PIECE, OVERLAP = 1 << 20, 1 << 12
#: Levels of compressed data that are inflated together, where each is too large to be held.
DEEPEST = 100
#: Where gzip or zlib data may begin; and bytes that may hold a secret: the shortest one has 12 ASCII characters, in any encoding.
COMPRESSED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
LEGIBLE = re.compile(rb"[\x00-\x7f]{12}")

#: A layer: its text, and for each of its characters where the original stretch begins and ends.
Layer = tuple[str, np.ndarray, np.ndarray]


def scan(text: str) -> list[tuple[str, int, int]]:
    """The secrets of one layer as (kind, start, end); leftmost and non-overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _spliced(text: str, pattern: re.Pattern, decode) -> Layer | None:
    """The text with each match of pattern decoded; None if none can be. Characters between keep their own positions."""
    out, starts, ends, at = [], [], [], 0

    def plain(a: int, b: int) -> None:
        out.append(text[a:b])
        starts.append(np.arange(a, b))
        ends.append(np.arange(a + 1, b + 1))

    for m in pattern.finditer(text):
        for a, b, new in decode(m):
            plain(at, a)
            out.append(new)
            starts.append(np.full(len(new), a))
            ends.append(np.full(len(new), b))
            at = b
    if not out:
        return None
    plain(at, len(text))
    return "".join(out), np.concatenate(starts), np.concatenate(ends)


def _url(m: re.Match) -> list[tuple[int, int, str]]:
    """The stretches of a run of escapes that are UTF-8, decoded."""
    places = [(x.start(), x.end(), int(x[1], 16)) for x in URL_BYTE.finditer(m.string, *m.span())]
    data = bytes(x for _, _, x in places)
    return [(places[x.start()][0], places[x.end() - 1][1], x[0].decode()) for x in UTF8.finditer(data)]


def _unicode(m: re.Match) -> list[tuple[int, int, str]]:
    code = int(next(filter(None, m.groups())), 16)
    return [(*m.span(), chr(code))] if code < 0x110000 else []


def _utf16(text: str) -> Layer | None:
    """The text without the zeros of UTF-16; None if it has none. A character keeps its own place and that of its zero."""
    starts, keep = np.arange(len(text)), np.ones(len(text), bool)
    ends = starts + 1
    for m in UTF16.finditer(text):
        a, b = m.span()
        if text[a] == "\0":
            keep[a:b:2] = False
            starts[a + 1 : b : 2] -= 1
        else:
            keep[a + 1 : b : 2] = False
            ends[a:b:2] += 1
    return None if keep.all() else (UTF16.sub(lambda m: m[0].replace("\0", ""), text), starts[keep], ends[keep])


def _compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0)


def _decompressed(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What zlib or gzip data holds, all members of it, up to its end or to the first fault."""
    z = zlib.decompressobj(47)
    for data in chunks:
        while data:
            try:
                out = z.decompress(data, 1 << 16)
            except zlib.error:
                return
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                if not _compressed(z.unused_data):
                    return
                data, z = z.unused_data, zlib.decompressobj(47)
    while out := z.decompress(z.unconsumed_tail, 1 << 16):
        yield out


def _large(chunks: Iterator[bytes], depth: int) -> tuple[Iterator[bytes], bool]:
    """The chunks, inflated as often as they are compressed data; and whether that went on beyond DEEPEST levels."""
    first = next(chunks, b"")
    while len(first) < 3 and (more := next(chunks, None)) is not None:
        first += more
    if not _compressed(first) or depth == DEEPEST:
        return chain([first], chunks), _compressed(first)
    inner = _decompressed(chain([first], chunks))
    head = next(inner, None)
    if head is None or first.startswith(head):  # data that inflate to themselves end here
        return iter([first]), False
    return _large(chain([head], inner), depth + 1)


def _inflated(data: memoryview, most: int, known: set) -> tuple[Iterator[bytes], bool] | None:
    """What compressed data holds, inflated as often as it is compressed itself, and whether something in it is left compressed; None if nothing can be
    inflated, or it leads to compressed data that another stretch led to (digests of these are in known)."""
    inner, own = None, set()
    while True:
        # in short steps, as what only looks like compressed data ends soon
        chunks, held, size = _decompressed(bytes(data[i : i + 4096]) for i in range(0, len(data), 4096)), [], 0
        for chunk in chunks:
            held.append(chunk)
            size += len(chunk)
            if size > most:
                return _large(chain(held, chunks), 0)
        if not size:
            return None if inner is None else (iter([inner]), False)
        inner = b"".join(held)
        key = hashlib.blake2b(inner, digest_size=16).digest()
        if not _compressed(inner) or key in own:
            return iter([inner]), False
        if key in known:
            return None
        own.add(key)
        known.add(key)
        data = memoryview(inner)


def _pieces(chunks: Iterator[bytes], most: int) -> Iterator[tuple[str, bool]]:
    """The text of the chunks piece by piece, and whether more than `most` characters have come. A piece begins again with the end of the one before: the
    OVERLAP last characters at least, and all of a run that may be encoded, unless the run is longer than `most`."""
    decoder, text, total, size = codecs.getincrementaldecoder("utf-8")("replace"), "", 0, min(PIECE, max(most, 4 * OVERLAP))
    kept = 0
    for chunk in chunks:
        new = decoder.decode(chunk)
        text, total = text + new, total + len(new)
        if len(text) - kept >= size:
            yield text, total > most
            cut = len(text)
            while cut and len(text) - cut < most and (text[cut - 1].isalnum() or text[cut - 1] in "+/_=-%\\\r\n"):
                cut -= 1
            if len(text) - cut >= most:
                cut = len(text)
            text = text[max(0, min(cut, len(text) - OVERLAP)) :]
            kept = len(text)
    text += decoder.decode(b"", True)
    if len(text) > kept or total:
        yield text, total > most


def _base64(code: str, at: np.ndarray, most: int, known: set) -> Iterator[tuple[Layer, bool]]:
    """The layers that base64 holds, wherever in its first four characters it begins; at: the position of each of its characters."""
    code = code.rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(4):
        own = code[k : len(code) - ((len(code) - k) % 4 == 1)]  # without a last character that is no byte
        data, place = binascii.a2b_base64(own + "=" * (-len(own) % 4)), at[k:]
        for m in COMPRESSED.finditer(data):
            if m.start() % 3 == 0 and (inner := _inflated(memoryview(data)[m.start() :], most, known)):
                a, b = int(place[m.start() // 3 * 4]), int(place[-1]) + 1
                for text, partial in _pieces(inner[0], most):
                    yield (text, np.full(len(text), a), np.full(len(text), b)), partial or inner[1]
        if not LEGIBLE.search(data):
            continue
        text = data.decode(errors="surrogateescape")
        if text.isascii():
            first = last = np.arange(len(text))
        else:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1  # bytes that aren't text
            last = np.cumsum(width) - 1
            first = last - width + 1
        yield (text, place[first // 3 * 4], place[np.minimum(len(place) - 1, last // 3 * 4 + 3)] + 1), False


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """Stretches of lines that base64 may be wrapped over: lines of one length, and a last one that isn't longer. Each line is in two stretches at most."""
    for run in WRAPPED.finditer(text):
        lines = [m.span() for m in LINE.finditer(text, *run.span())]
        size = [b - a for a, b in lines]
        k = 0
        while k < len(lines) - 1:
            end = k + 1
            while end < len(lines) and size[end] == size[k]:
                end += 1
            last = end
            if last < len(lines) and size[last] < size[k]:
                last += 1
            if last - k > 1:
                yield lines[k:last]
            k = end


def layers(text: str, most: int, known: set) -> Iterator[tuple[Layer, bool]]:
    """What the encoded stretches of one text hold."""
    if "%" in text and (layer := _spliced(text, URL_BYTES, _url)):
        yield layer, False
    if "\\" in text and (layer := _spliced(text, UNICODE_ESCAPE, _unicode)):
        yield layer, False
    if "\0" in text and (layer := _utf16(text)):
        yield layer, False
    for run in BASE64_RUN.finditer(text):
        yield from _base64(run[0], np.arange(*run.span()), most, known)
    for lines in _wrapped(text) if "\n" in text else ():
        yield from _base64("".join(text[a:b] for a, b in lines), np.concatenate([np.arange(a, b) for a, b in lines]), most, known)


class _Spans:
    """Spans by kind. One that lies within another of its kind, come before, isn't added."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.all, self.widest = set(), {}
        for span in spans:
            self.all.add(span)
            self._widen(*span)

    def _widen(self, kind: str, a: int, b: int) -> None:
        """Of each kind, those within no other, in order: their starts and ends rise together."""
        starts, ends = self.widest.setdefault(kind, ([], []))
        lo, hi = bisect_left(starts, a), bisect_right(ends, b)
        if not self.holds(kind, a, b):
            starts[lo : max(lo, hi)], ends[lo : max(lo, hi)] = [a], [b]

    def holds(self, kind: str, a: int, b: int) -> bool:
        starts, ends = self.widest.get(kind, ([], []))
        at = bisect_right(starts, a) - 1
        return at >= 0 and ends[at] >= b

    def add(self, kind: str, a: int, b: int) -> None:
        if not self.holds(kind, a, b):
            self.all.add((kind, a, b))
            self._widen(kind, a, b)


def find(text: str | None, most: int = 1 << 24) -> tuple[list, list]:
    """(spans of the text itself, all spans) in order. A compressed stretch that inflates beyond `most` characters is scanned to its end in
    pieces as well, and reported whole as a span of kind `partial` too."""
    text = text or ""
    base = scan(text)
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    known: set = set()
    spans, seen, work = _Spans(base), {digest(text)}, [(layers(text, most, known), None, None)]
    while work:
        above, starts, ends = work[-1]
        if (got := next(above, None)) is None:
            work.pop()
            continue
        (inner, s, e), partial = got
        if not inner:
            continue
        if starts is not None:  # from positions in the layer above to positions in the original
            s, e = starts[s], ends[e - 1]
        if partial:
            spans.all.add(("partial", int(s[0]), int(e[-1])))
        if (key := digest(inner)) in seen:
            continue
        seen.add(key)
        for kind, a, b in scan(inner):
            spans.add(kind, int(s[a]), int(e[a:b].max()))
        work.append((layers(inner, most, known), s, e))
    order = {k: i for i, k in enumerate((*KINDS, "partial"))}
    key = lambda x: (x[1], order[x[0]], x[2])
    return sorted(base, key=key), sorted(spans.all, key=key)


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 24) -> DataFrame:
    """One row per document: counts of the secrets of the text itself, the SHA-256 of their list, and all spans as kind:start:end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for i, text in zip(x["id"], x["text"], strict=True):
                base, spans = find(text, most)
                rows.append((i, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    # Ids travel as strings: a null among whole numbers would make them doubles in pandas.
    x = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    return x.mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumn("doc_id", F.col("doc_id").cast("long"))
