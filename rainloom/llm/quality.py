"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over the buckets are counted:
the raw corpus (every document) and the trusted target (labelled documents of good quality that aren't toxic; a bounded
sample of `trusted` labels). A document's score is the sum of the log ratios of its n-grams, target over raw, divided by their number.
Log ratios are rounded to integers of 2**-20, so sums don't depend on their order and every rerun decides alike. A document is kept if
its score reaches the threshold. Half of the trusted documents (by the hash of their ids) fit the target; the threshold comes from the scores of the
other half, which judge the fit as any other document does: their first percentile, less `spread` times its distance from their median.

The mean can't see a few insults in a long text, so toxic documents are found by their worst n-gram: words and pairs that come in two or more toxic documents
of the fitting half are weighed by the log ratio of their document frequencies, toxic over trusted, and a document's harm is its largest weight. It is rejected
above a cut between the other halves (toxicity is judged by these marks alone; without labelled toxic documents it isn't judged): the middle of the trusted 99th percentile and the toxic fifth percentile, but never below the former.

Cases: a null or empty text has no words and fails the base rules; rows that repeat an id are judged by their own texts; ids without labels count in the raw corpus only; without trusted labels every score is 0 and only base rules decide; without toxic or trusted labels in the second halves no harm is rejected; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import WORD, let, stash, words

ONE = 1 << 20


def hashed(docs: DataFrame) -> DataFrame:
    """docs (…, text) with w, the words, and hashes of words (one), of pairs (two) and of triples (three) of neighbours. Each column is computed from the one before."""
    x = docs.withColumn("w", words(F.col("text")))
    x = x.withColumn("one", F.transform("w", lambda v: F.xxhash64(v)))
    part = lambda c, at, n: F.slice(c, at, F.greatest(F.size(c) - n, F.lit(0)))
    x = x.withColumn("two", F.zip_with(part("one", 1, 1), part("one", 2, 1), lambda a, b: F.xxhash64(a, b)))
    return x.withColumn("three", F.zip_with(part("two", 1, 1), part("one", 3, 2), lambda a, b: F.xxhash64(a, b)))


def repeated_words(three: Column) -> Column:
    """How many words lie in a window of three words that comes twice or more, from the hashes of all windows."""

    def places(s: Column) -> Column:
        same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    ranked = F.sort_array(F.transform(three, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(three)) == F.size(three), F.lit(0).cast("long")).otherwise(let(let(ranked, places), covered))


def base_columns() -> dict[str, Column]:
    """Of `hashed` documents."""
    text, w = F.col("text"), F.col("w")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(F.col("three")),
    }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counts(docs: DataFrame, buckets: int) -> dict[int, int]:
    """How many words and pairs of neighbours fall into each bucket. `buckets` rows come to the driver."""
    g = hashed(docs.select("text")).select(F.explode(F.concat("one", "two")).alias("h"))
    rows = g.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n")).collect()
    return {r.bucket: r.n for r in rows}


def model(docs: DataFrame, fit: DataFrame, buckets: int, prior: float) -> list[int]:
    """The weight of every bucket: the log ratio in units of 2**-20, 0 where the corpus has none of it. fit: ids of the target, few enough to broadcast."""
    raw, target = _counts(docs, buckets), _counts(docs.join(F.broadcast(fit), "doc_id", "left_semi"), buckets)
    r, t = sum(raw.values()), sum(target.values())
    out = [0] * buckets
    for b, n in raw.items() if t else ():
        out[b] = round(math.log((target.get(b, 0) + prior * n / r) / (t + prior) / (n / r)) * ONE)
    return out


def markers(docs: DataFrame, trusted: DataFrame, toxic: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """For every bucket the hash of its heaviest marker of toxic documents, and that marker's weight in units of 2**-20 (0 and 0 without one). At most buckets / 4 markers come to the driver."""
    side = trusted.select("doc_id", F.lit(0).alias("bad")).unionByName(toxic.select("doc_id", F.lit(1).alias("bad")))
    # Both samples are bounded, so safe to broadcast.
    x = hashed(docs.join(F.broadcast(side), "doc_id").select("text", "bad")).select("bad", F.array_distinct(F.concat("one", "two")).alias("grams"))
    hashes, weights = [0] * buckets, [0] * buckets
    size = {r.bad: r.n for r in x.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return hashes, weights
    seen = x.select("bad", F.explode("grams").alias("h")).groupBy("h").agg(F.sum("bad").alias("a"), F.sum(1 - F.col("bad")).alias("b")).where("a >= 2")
    weight = F.log((F.col("a") + 0.5) / (size[1] + 1)) - F.log((F.col("b") + 0.5) / (size[0] + 1))
    for r in seen.withColumn("w", F.round(weight * ONE).cast("long")).where("w > 0").orderBy(F.desc("w"), "h").limit(buckets // 4).collect():
        if not weights[r.h % buckets]:
            hashes[r.h % buckets], weights[r.h % buckets] = r.h, r.w
    return hashes, weights


def judge_quality(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, text_key (hash of its text), the base columns, base_failed, score, kept. After the count of the n-grams nothing is shuffled."""
    judged, kept = _judged(docs, labels, None, **params)
    return judged.select("doc_id", "text_key", *BASE, "base_failed", (F.col("units") / ONE).alias("score"), kept.alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that `judge_quality` keeps, each judged for itself."""
    judged, kept = _judged(docs, labels, F.struct(*[docs[c] for c in docs.columns]), **params)
    return judged.where(kept).select("row.*")


def _judged(docs: DataFrame, labels: DataFrame, row: Column | None, buckets: int = 1 << 16, trusted: int = 20_000, prior: float = 10_000.0, spread: float = 1.0) -> tuple[DataFrame, Column]:
    """A stashed table with a judgement for each document, beside `row` if there is one, and what tells whether it is kept."""
    x = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *([] if row is None else [row.alias("row")]))
    plain = x.select("doc_id", "text")
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    sample = stash(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted), "quality-sample")  # bounded, so safe to broadcast
    bad = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    toxic = stash(bad.join(F.broadcast(sample), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted), "quality-toxic")
    even = F.xxhash64("doc_id", F.lit("fit")) % 2 == 0
    # The weights are one literal array of fixed length; a document looks its buckets up in it.
    literal = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>")
    weights = literal(model(plain, sample.where(even), buckets, prior))
    marker, heavy = (literal(v) for v in markers(plain, sample.where(even), toxic.where(even), buckets))
    slot = lambda h: (F.pmod(h, F.lit(buckets)) + 1).cast("int")
    marked = F.filter(F.concat("one", "two"), lambda h: F.element_at(marker, slot(h)) == h)
    harm = F.coalesce(F.array_max(F.transform(marked, lambda h: F.element_at(heavy, slot(h)))), F.lit(0).cast("long"))
    total = F.aggregate(F.concat("one", "two"), F.lit(0).cast("long"), lambda a, h: a + F.element_at(weights, (F.pmod(h, F.lit(buckets)) + 1).cast("int")))
    n = F.greatest(F.size("one") + F.size("two"), F.lit(1))
    own = [] if row is None else ["row"]
    y = hashed(x).select("doc_id", F.xxhash64("text").alias("text_key"), *own, *[c.alias(k) for k, c in base_columns().items()], F.round(total / n).cast("long").alias("units"), harm.alias("harm"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stash(y.withColumn("base_failed", failed), "quality-scores")
    held_out = scored.where("not base_failed").join(F.broadcast(sample.where(~even)), "doc_id", "left_semi")
    # exact, over bounded samples
    low, middle, harmless = held_out.agg(F.percentile("units", F.lit(0.01)), F.percentile("units", F.lit(0.5)), F.percentile("harm", F.lit(0.99))).first()
    cut = -(1 << 62) if low is None else round(low - spread * (middle - low))
    harmful = scored.where("not base_failed").join(F.broadcast(toxic.where(~even)), "doc_id", "left_semi").agg(F.percentile("harm", F.lit(0.05))).first()[0]
    most = 1 << 62 if harmless is None or harmful is None else round(max(harmless, (harmless + harmful) / 2))
    return scored, ~F.col("base_failed") & (F.col("units") >= cut) & (F.col("harm") <= most)
