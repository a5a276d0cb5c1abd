"""Importance resampling, piece encoding and hard negatives against plain computations, also on odd tables."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from rainloom.llm import importance, negatives, pieces
from rainloom.llm.queries import QUERIES, vocabulary

CLASH = ["row", "part", "rank", "score", "weight", "n_words", "id", "label2", "vector", "g", "h", "dims", "place", "p", "j", "scores", "ids", "decoded", "agrees", "before", "size"]


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") if i % 2 else F.lit(None).cast("string") for i, c in enumerate(CLASH)})


# --- importance resampling


def plain_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent, least, buckets, longest):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, want = (Counter(bucket(f) for t in texts for f in plain_features(t, longest)[1]) for texts in ([t for _, t in docs], target))
    s, t = sum(raw.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    rows = []
    for i, text in docs:
        words, features = plain_features(text, longest)
        weight = sum(map(gain, map(bucket, features))) // len(features) if features else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    ranked = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(ranked[: percent * len(ranked) // 100], 1):
        r[4] = place
    return Counter(map(tuple, rows))


def odd_documents():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Rain", "storm", "née", "漢字", "x1", "a_b", "tok%en", "Ünder", "word" + str(rng.randrange(200))]) for _ in range(n))
    docs = [(i, text(rng.randrange(5, 60))) for i in range(300)]
    docs += [(None, text(40)), (None, None), (7, docs[7][1]), (7, docs[7][1]), (8, text(30)), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "word " * 200_000), (1004, "x" * 1_000_000), (1005, "\x00\x7f{}[]`@/:;~!é" * 10)]
    return docs + [(2000, docs[3][1])] * 120, [text(40), None, "", "Rain storm", text(300)]


@pytest.mark.parametrize("longest,percent,least", [(1, 10, 20), (2, 37, 1), (3, 100, 0), (1, 0, 20)])
def test_resampling_equals_plain(spark, longest, percent, least):
    docs, target = odd_documents()
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    wanted = with_clashes(spark.createDataFrame([(t,) for t in target], "text string"))
    out = importance.resample(df, wanted, percent=percent, least=least, buckets=500, longest=longest)
    assert Counter(map(tuple, out.collect())) == plain_resample(docs, target, percent, least, 500, longest)


def test_resampling_of_empty_tables(spark):
    docs, target = (spark.createDataFrame(rows, s) for rows, s in (([(1, "a b " * 20), (2, None)], "doc_id long, text string"), ([("a",)], "text string")))
    assert importance.resample(docs.limit(0), target).collect() == []
    assert {r.doc_id: r.n_features for r in importance.resample(docs, target.limit(0)).collect()} == {1: 40, 2: 0}
    none = docs.select("doc_id", F.lit(None).cast("string").alias("text"))
    assert all((r.n_features, r.weight, r["rank"]) == (0, 0, None) for r in importance.resample(none, target).collect())


def test_features_remembered_in_turns(monkeypatch):
    monkeypatch.setattr(importance, "REMEMBERED", 3)
    known = importance._Buckets(100)
    texts = [f"w{i} w{i + 1} w{i}".encode() for i in range(50)]
    found, n, _ = importance._features(texts, 1, known)
    assert found.tolist() == [zlib.crc32(w) % 100 for t in texts for w in t.split()] and set(n) == {3} and len(known) <= 3


# --- pieces


def odd_texts(spark, sf_dir):
    rng = random.Random(5)
    pool = ["storm", " ", "  ", "\n", "\n\n", "▁", "é", "é", "漢字", "🎉", "\x00", "\x85", "</s>", "<0x41>", "ﬁ", "　", "​", "aaaa", "http://", "0001", ".", "...", "\t", "Ærø", "the", "ing"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(800)]
    texts += ["x" * 100_000, "ab" * 50_000, " " * 50_000, "漢" * 50_000, "the storm " * 20_000, "", None, " ", "\n"]
    return texts + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_pieces_equal_the_library(spark, sf_dir):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts(spark, sf_dir)
    own = pieces.Merger(path)
    for t in texts:  # the agenda itself, without the check behind it
        assert own.encode(t or "") == sp.encode(t or "")
    df = with_clashes(spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5))
    want = Counter()
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_eos=True)
        want[(i if i % 9 else None, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest(), True)] += 1
    assert Counter(map(tuple, pieces.encoding_report(df, path).collect())) == want
    assert pieces.encoding_report(df.limit(0), path).collect() == []
    whole = pieces.encode_documents(df, path, whole=True)
    assert whole.where("not agrees").isEmpty() and whole.count() == len(texts)


def test_pieces_forget_and_fall_back(monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "REMEMBERED", 2)
    own = pieces.Merger(path)
    text = "one two three four one two  three\nfour"
    for _ in range(3):
        assert own.encode(text) == own.library.encode(text)
        assert not own.memo and 4 < len(own.old) < 9


def test_pieces_one_by_one_and_together():
    own = pieces.Merger(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(9)
    texts = ["".join(rng.choice("▁▁aeinrstthdé漢🎉.0123\n") for _ in range(rng.randrange(1, 48))) for _ in range(3000)]
    assert own._merge_many(texts) == [tuple(own._merge(t)) for t in texts]


def test_pieces_disagreement_is_reported(spark, monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    other = pieces.Merger(path)
    other.rank_of[:] = pieces.NEVER  # a vocabulary that the agenda reads wrongly
    monkeypatch.setattr(pieces, "merger", lambda p: other)
    df = spark.createDataFrame([(1, "a storm"), (2, "")], "doc_id long, text string").coalesce(1)
    for whole in (False, True):
        row, empty = sorted(pieces.encode_documents(df, path, whole=whole).collect())
        assert row.ids == other.library.encode("a storm", add_eos=True) and not row.agrees and row.decoded == "a storm" and empty.agrees


def test_pieces_check_finds_a_wrong_stretch():
    own = pieces.Merger(vocabulary("piece_bpe_32k.model"))
    text = "the storm went\non and  on é🎉"
    assert own.encode(text) == own.library.encode(text) and not own.doubtful
    own.memo["▁storm"] = (5, 6)
    own._check(["▁the", "▁storm", "▁▁on"])
    assert own.doubtful == {"▁storm"}
    ids = own.encode_all([text, "no"])
    assert own.agreeing([text, "no"], ids, False) == [own.library.encode(text), None]


# --- hard negatives


def plain_mining(rows, n_positives=5, k=3, every=50):
    ok = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, v, (l + 1) % 10 if i is not None and i % 7 == 0 else l) for i, v, l in ok]
    out = Counter()
    for i, a, label in ok:
        if i is None or i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v, strict=True)), j is None, j or 0, l == label) for j, v, l in ok if j != i and len(v) == len(a)))
        for p in [s for s in scored if s[3]][:n_positives]:
            fit = [s for s in scored if not s[3] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:k]
            for rank, s in enumerate(fit, 1):
                out[(i, None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0])] += 1
    return out


def odd_vectors(scale=1.0):
    rng = random.Random(11)
    rows = [(i, [scale * (rng.random() + rng.choice([0, 0, -0.5])) for _ in range(6)], rng.randrange(10)) for i in range(400)]
    rows += [(None, [0.5] * 6, 3), (None, [0.25] * 6, 4), (50, [0.3] * 6, 2), (51, rows[51][1], 4), (401, None, 1), (402, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 1), (405, [0.5] * 6, None), (406, [], 1), (450, [], 2), (407, [0.5] * 3, 2), (500, [0.25] * 3, 2), (408, [0.4] * 3, 3), (550, [0.0] * 6, 5)]
    return rows + [(600 + i, [0.75] * 6, i % 3) for i in range(150)]


@pytest.mark.parametrize("block,scale", [((2048, 8192), 1.0), ((3, 40), 1.0), ((5, 70), 30000.0), ((5, 70), 3e6)])
def test_negatives_equal_plain(spark, block, scale):
    rows = odd_vectors(scale)
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6))
    got = negatives.mine(df, block=block)
    assert Counter(map(tuple, got.collect())) == plain_mining(rows)
    assert negatives.mine(df.limit(0)).collect() == []


def test_sorting_without_room_to_pack():
    import numpy as np

    s = np.array([[5, 1 << 61, 5, -(1 << 61), 0]])
    places, scores = negatives._sorted(s)
    assert places.tolist() == [[1, 0, 2, 4, 3]] and scores.tolist() == [[1 << 61, 5, 5, 0, -(1 << 61)]]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_piece_encoding", "op13_hard_negatives"])
def test_registered(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    first = Counter(map(tuple, df.collect()))
    assert first and first == Counter(map(tuple, QUERIES[name](spark, sf_dir).collect()))


def test_queries_equal_plain(spark, sf_dir):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).collect()]
    docs, target, vectors = read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")], read("embeddings", "vec_id", "embedding", "label")
    assert Counter(map(tuple, QUERIES["op11_importance_resampling"](spark, sf_dir).collect())) == plain_resample(docs, target, 10, 20, 10_000, 1)
    assert Counter(map(tuple, QUERIES["op13_hard_negatives"](spark, sf_dir).collect())) == plain_mining(vectors)
