"""Quality rules, URL filter and mixing against brute force, and odd input."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from rainloom.llm import mixing, quality, urls
from rainloom.llm.queries import op1_quality_rules, op5_mixing, op8_url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "one", "a b a b a b a b", "x " * 60, "l1 é\nl1 é\n\n \nl1 é\nother", "a#*$%&|<>\x0b\x0cb\x85c d e", "a b c a b c d a b c", "w\u2003x", "\n\n\n", "a b c d a b"]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, hit = defaultdict(list), set()
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_columns(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()} | {10**6 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    for r in quality.hashed(df).select("doc_id", *[c.alias(k) for k, c in quality.base_columns().items()]).collect():
        assert tuple(r)[1:] == base(rows[r.doc_id]), rows[r.doc_id]


def test_scores(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = sorted(r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect())
    fits = {r.doc_id: r.fit for r in spark.createDataFrame([(i,) for i in good], "doc_id long").select("doc_id", (F.xxhash64("doc_id", F.lit("fit")) % 2 == 0).alias("fit")).collect()}
    def grams(text):
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        hash64 = lambda data, seed: xxhash.xxh64_intdigest(data, seed=seed)
        h = [hash64(w.encode(), 42) for w in WORD.findall(text)]
        two = [hash64(struct.pack("<Q", b), hash64(struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:], strict=False)]
        return [signed(x) % (1 << 16) for x in h + two]

    raw, target = Counter(), Counter()
    for i, t in docs.items():
        raw.update(grams(t))
        if fits.get(i):
            target.update(grams(t))
    r, t = sum(raw.values()), sum(target.values())
    weight = {b: round(math.log((target[b] + 10_000 * raw[b] / r) / (t + 10_000) / (raw[b] / r)) * quality.ONE) for b in raw}
    got = {x.doc_id: x for x in op1_quality_rules(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        g = grams(text)
        assert got[i].score == pytest.approx(sum(weight[b] for b in g) / max(1, len(g)) / quality.ONE, abs=2e-6)
        n, *_, again = base(text)
        assert got[i].base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (got[i].kept and got[i].base_failed)
    clean = [got[i] for i in good if not got[i].base_failed]
    assert sum(x.kept for x in clean) >= 0.97 * len(clean)


def test_toxic_documents_go(spark):
    """A few insults in long prose: nearly all documents with them go, labelled or not, and nearly all clean ones stay."""
    rng = random.Random(5)
    insults = [f"slur{i}" for i in range(8)]
    rows = []
    for i in range(600):
        w = [rng.choice("bcdfgh") + str(rng.randrange(900)) for _ in range(150)]
        for at in rng.sample(range(150), 3) if i % 6 == 0 else ():
            w[at] = rng.choice(insults)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge_quality(docs, labels).where("kept").collect()}
    assert sum(i % 6 == 0 for i in kept) <= 5
    assert sum(i % 6 > 0 for i in kept) >= 485


def test_quality_odd(spark):
    rows = [(i, t, "k") for i, t in enumerate(ODD)] + [(3, "one", "k"), (None, "null id", "k"), (3, "another text of id three", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(docs, labels).count() == len(rows)
    assert quality.judge_quality(docs, labels.limit(0)).count() == len(rows)
    assert quality.judge_quality(docs.limit(0), labels).count() == 0


URLS = [None, "", "no scheme/en/", "http://a.com/en/x", "HTTP://Example.COM/en/7?x=1", "x://y://z.com/en/", "http://com/en/", "http://acom/en/", "https://deep.sub.net/de/#f", "http://example.net/de/8a", "http://x.example.net/de/9", "//a.org/es/", "s://a.org/es/q?y", "http://b.org:80/es/", "http://É.com/EN/"]


def rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark, sf_dir):
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()} | {10**6 + i: u for i, u in enumerate(URLS)}
    df = spark.createDataFrame(list(rows.items()), "page_id long, url string").withColumn("score", F.lit("clash"))
    got = urls.judge_urls(df).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, fits, verdict = rule(rows[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, fits)
        assert r.verdict == verdict if verdict else r.verdict == ("block" if r.score >= 0.5 else "allow")
    again = {r.page_id: (r.verdict, r.score) for r in urls.judge_urls(df).collect()}
    assert again == {r.page_id: (r.verdict, r.score) for r in got}


def test_url_features(spark):
    url = "http://a.b.com/x1/y?k=v&l=22"
    h, p = urls.host_and_path(F.col("url"))
    row = spark.createDataFrame([(url,)], "url string").withColumns({"host": h, "path": p}).select(*[c.alias(k) for k, c in urls.lexical(F.col("url"), F.col("host"), F.col("path")).items()]).first()
    n = len(url)
    assert row.entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(url).values()))
    assert (row.depth, row.labels, row.params, row.digits) == (2, 3, 2, pytest.approx(3 / n))


def test_url_trees_learn(spark):
    """Held-out accuracy where numbers in the path tell the classes apart."""
    labelled = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://w"), F.col("id"), F.lit(".x/"), F.col("id") * 977, F.lit("/"), F.col("id") * 31)).otherwise(F.concat(F.lit("http://w"), F.col("id"), F.lit(".x/words/only"))).alias("url"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    test = spark.range(1000, 1200).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://w"), F.col("id"), F.lit(".x/"), F.col("id") * 977, F.lit("/"), F.col("id") * 31)).otherwise(F.concat(F.lit("http://w"), F.col("id"), F.lit(".x/words/only"))).alias("url"))
    got = urls.judge_urls(test, labelled=labelled).collect()
    assert sum(r.verdict == ("block" if r.page_id % 2 == 0 else "allow") for r in got) >= 195


def test_urls_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/"), (2, "http://z/q")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(df).collect()} == {1: "block", 2: "block"}
    assert {r.verdict for r in urls.judge_urls(df.where("page_id = 2")).collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0)).collect() == []
    assert len(op8_url_filter.__name__) > 0


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left, open_ = left - sum(cap * sizes[s] for s in over), open_ - over
    return out


def tilt(sizes, target):
    """The multiplier by bisection."""
    mean = sum(sizes) / len(sizes)
    total = lambda x: sum(s * min(2.0, math.exp(min(x * s / mean, 1))) for s in sizes)
    lo, hi = -1e4, math.log(2) / (min(s for s in sizes if s) / mean)
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < target else (lo, mid)
    return [min(2.0, math.exp(min(hi * s / mean, 1))) for s in sizes]


def test_mixing(spark, sf_dir):
    got = op5_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len(WORD.findall(docs[r.doc_id].text)) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = filled(sizes)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.source_size == sizes[r.source]
    for s, rows in by.items():
        assert target[s] == pytest.approx(want[s])
        assert 0 <= want[s] - taken[s] <= max(r["size"] for r in rows)
        if want[s] < 2 * sizes[s]:
            assert [r.rate for r in rows] == pytest.approx(tilt([r["size"] for r in rows], want[s]), abs=1e-6)
    again = {r.doc_id: r.taken for r in op5_mixing(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mixing_odd(spark):
    rows = [(1, None, None, 1), (2, "", "b", 2), (3, "a b c", None, 3), (3, "a b c", None, 3), (None, "x y", "a", 4), (5, "w " * 5000, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix_documents(docs).columns == docs.columns
