"""URL filters: domain rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

Rules label the URLs that they fit. The trees learn from a bounded sample of labelled URLs (`sample` rows, those with the
smallest hashes) and judge all others. Features: lengths, depth, label count, digit ratio, character entropy, parameter
count, punctuation, and the smoothed share of blocked URLs and the count of labelled ones under the host's suffix. What trains the trees gets the suffix statistics of
the other folds (FOLDS, by the hash of the URL), so that they don't tell a row its own label.

Cases: a null URL, or one without ://, has empty host and path, fits no rule and is judged by the trees; without labelled URLs of both verdicts every
URL that no rule fits gets the only verdict seen, or allow; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import lower_ascii, stash

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

FOLDS = 5
FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digits", "entropy", "params", "marks", "suffix_rate", "suffix_count")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        at, below = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features as doubles. Character entropy is in bits, over the characters of the whole URL."""
    url = F.coalesce(url, F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")

    def bits(chars: Column) -> Column:
        share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))

    out = {
        "n_url": F.length(url),
        "n_host": F.length(host),
        "n_path": F.length(path),
        "depth": count(path, "/[^/]"),
        "labels": count(host, r"\.") + 1,
        "digits": count(url, "[0-9]") / n,
        "entropy": F.when(F.length(url) > 0, bits(F.array_remove(F.split(url, ""), ""))).otherwise(0.0),
        "params": count(url, r"[?&][^?&#]*="),
        "marks": count(url, "[^A-Za-z0-9]") / n,
    }
    return {k: v.cast("double") for k, v in out.items()}


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, sample: int = 20_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the trees' probability of block). labelled: further (url, verdict) rows to learn from."""

    def described(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        x = df.withColumns({"host": host, "path": path})
        x = x.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
        x = x.withColumn("suffix", F.regexp_extract("host", r"([^.:]*)(?::\d+)?$", 1))
        return x.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))

    x = described(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")))
    known = x.where("hit is not null").select("url", "suffix", *FEATURES[:-2], F.col("hit.verdict").alias("verdict"))
    if labelled is not None:
        known = known.unionByName(described(labelled.select("url", "verdict").where("verdict is not null")).select(*known.columns))
    # Distinct URLs, so that a page of a thousand copies counts once; the sample is bounded and one sorted file, so that reruns agree.
    train = known.dropDuplicates(["url", "verdict"]).orderBy(F.xxhash64("url"), "url", "verdict").limit(sample)
    train = stash(train.withColumn("label", (F.col("verdict") == "block").cast("double")).coalesce(1), "url-sample")
    classes = train.groupBy("verdict").count().collect()  # two rows at most
    prior = F.lit(sum(r["count"] for r in classes if r["verdict"] == "block") / max(1, sum(r["count"] for r in classes)))
    train = train.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)))
    suffixes = train.groupBy("suffix").agg(F.count("*").alias("all_n"), F.sum("label").alias("all_bad"))
    folds = train.groupBy("suffix", "fold").agg(F.count("*").alias("own_n"), F.sum("label").alias("own_bad"))

    def assembled(df: DataFrame, own: bool) -> DataFrame:
        # no more rows than the sample on the other sides: safe to broadcast
        y = df.join(F.broadcast(suffixes), "suffix", "left")
        y = y.join(F.broadcast(folds), ["suffix", "fold"], "left") if own else y.withColumns({"own_n": F.lit(0), "own_bad": F.lit(0.0)})
        none = F.lit(0)
        n, bad = F.coalesce("all_n", none) - F.coalesce("own_n", none), F.coalesce("all_bad", none) - F.coalesce("own_bad", none)
        y = y.withColumns({"suffix_rate": (bad + prior * 5) / (n + 5), "suffix_count": F.log1p(n)})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(y)

    if len(classes) == 2:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, cacheNodeIds=False).fit(assembled(train, True).select("features", "label").coalesce(1))
        judged = model.transform(assembled(x, False))
        score = vector_to_array(F.col("probability"))[1]
    else:
        judged, score = x, F.lit(1.0 if classes and classes[0]["verdict"] == "block" else 0.0)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(score >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.round(score, 6).alias("score"))

