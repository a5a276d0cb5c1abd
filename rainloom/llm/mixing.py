"""Mixing sources to target weights by entropy balancing.

Every source gets a target: its share by weight of a total, stopped at `cap` times its own size, the excess reshared by
weight. Of all document rates q in [0, cap] whose words add up to the target, the mix takes those closest to 1 in
relative entropy. They are exponentially tilted, q = min(cap, exp(lambda * size / mean size)), with one multiplier lambda a source;
Newton iterations on the convex dual find it, over counts of (source, size), so an iteration reads no document. They go on until every source is solved. Rates become
whole copies by a threshold on hashed priorities, chosen so that each source's words come within about one document of its target.

The plan has a row for each source, so documents meet it in a join whose other side is small; documents themselves are not shuffled for it.

Cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, ordered last; documents of one
source with equal sizes have equal rates and differ by the hash of their ids and texts only, so rows that repeat both are taken alike; rows that repeat an id are mixed as rows
of their own; a null id is an id as any other; an empty table gives an empty result; other columns are kept by `mix_documents`, whatever their names, and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainloom.llm.common import WORD, stash

#: Priorities have three digits of so many bits.
DIGIT = 10


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """by_source (source, source_size) with sid, weight and target. Sources fill up to one level; which of them stop below it
    follows from their order by size over weight. Rows are sources, not documents."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    x = by_source.withColumn("sid", rank).withColumn("weight", F.element_at(cycle, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    filled = W.orderBy(F.col("source_size") / F.col("weight"), "sid")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    goal = F.lit(share) * F.sum("source_size").over(everything)
    full = F.lit(cap) * F.col("source_size")
    before = F.coalesce(F.sum(full).over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing))
    x = x.withColumn("level", (goal - before) / weight_left).withColumn("full", full)
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("full") * (1 + 1e-12), F.struct(F.col("source_size") / F.col("weight"), "sid", "level"))
    level = F.min(open_).over(everything).getField("level")
    return x.withColumn("target", F.least("full", F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).drop("level", "full")


def _newton(counts: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One step towards the root of sum(n * size * min(cap, exp(lam * size / mean))) = target for every row of state. lo and hi hold the root; a step that leaves them is halved."""
    most = F.log(F.lit(cap))
    c = F.col("size") / F.col("mean_size")
    tilt, word = F.exp(F.least(F.col("lam") * c, most)), F.col("n") * F.col("size")
    slope = F.sum(F.when(F.col("lam") * c < most, word * c * tilt).otherwise(0.0)).alias("slope")
    held = [F.first(k).alias(k) for k in state.columns if k != "sid"]
    x = counts.join(state, "sid").groupBy("sid").agg(*held, F.sum(word * tilt).alias("f"), slope)
    lam, lo, hi, gap = F.col("lam"), F.col("lo"), F.col("hi"), F.col("f") - F.col("target")
    x = x.withColumns({"lo": F.when(gap <= 0, lam).otherwise(lo), "hi": F.when(gap >= 0, lam).otherwise(hi)})
    narrow = (lo > float("-inf")) & ((hi - lo) <= 4e-16 * F.greatest(F.abs(hi), F.abs(lo)))
    x = x.withColumns({"newton": F.when(F.col("slope") > 0, lam - gap / F.col("slope")), "done": F.col("done") | (F.abs(gap) <= 1e-10 * F.col("target")) | narrow})
    half = F.when(lo == float("-inf"), hi * 2 - 1).otherwise((lo + hi) / 2)
    step = F.when((F.col("newton") > lo) & (F.col("newton") < hi), F.col("newton")).otherwise(half)
    return x.withColumn("lam", F.when(F.col("done"), lam).otherwise(step)).select(state.columns)


def _solve(counts: DataFrame, src: DataFrame, cap: float, steps: int = 4) -> DataFrame:
    """src with lam and whole (all words `cap` times). `steps` Newton steps make one job."""
    whole = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    highest = F.greatest(F.log(F.lit(cap)) / F.col("least_c"), F.lit(1e-9))
    state = src.select("sid", "target", "mean_size", (whole | (F.col("source_size") == 0)).alias("done"), F.lit(0.0).alias("lam"), highest.alias("hi"), F.lit(float("-inf")).alias("lo"))
    for _ in range(250):
        for _ in range(steps):
            state = _newton(counts, state, cap)
        state = stash(state, "mix-state", left=F.count_if(~F.col("done")))
        if not state.facts["left"]:
            # Sums of doubles differ in the last bits from run to run; a rounded multiplier doesn't.
            return src.join(state.select("sid", F.round("lam", 9).alias("lam")), "sid").withColumn("whole", whole)
    raise ArithmeticError("the mix has a source whose multiplier isn't found")  # halving alone ends sooner


def _rate(cap: float) -> Column:
    return F.when(F.col("whole"), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean_size"), F.log(F.lit(float(cap))))))


def _place(rate: Column) -> Column:
    """Where a document stands among those of its source that wait for one more copy; null where it doesn't wait."""
    base = F.floor(rate)
    place = F.floor((F.col("draw") - (rate - base) + 1) / 2 * (1 << 3 * DIGIT)).cast("long")
    return F.when((rate > base) & (F.col("size") > 0), place)


def _described(id_: Column, text: Column, source: Column) -> list[Column]:
    draw = F.pmod(F.xxhash64(id_.cast("long"), text), F.lit(1 << 52)) / float(1 << 52)
    return [source.alias("source"), sizes(text).alias("size"), draw.alias("draw")]


def _plan(x: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> DataFrame:
    """The mix of documents (source, size, draw): a row for each source with its target, multiplier and the place below which documents get one more copy."""
    raw = stash(x.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    positive = F.when(F.col("size") > 0, F.col("size"))
    by_source = raw.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows"), F.min(positive).alias("least"))
    mean = F.greatest(F.col("source_size") / F.col("rows"), F.lit(1e-9))
    src = stash(targets(by_source, weights, share, cap).withColumn("mean_size", mean).withColumn("least_c", F.coalesce("least", F.lit(1)) / F.col("mean_size")), "mix-sources")
    counts = stash(raw.alias("a").join(src.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("sid", "size", "n"), "mix-counts")
    solved = stash(_solve(counts, src, cap), "mix-solved")
    y = x.alias("a").join(solved.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).withColumn("rate", _rate(cap))
    edges = _edges(y.select("sid", "size", "target", F.floor("rate").cast("long").alias("base"), _place(F.col("rate")).alias("place")))
    return stash(solved.join(edges, "sid"), "mix-plan")


def _copies() -> Column:
    return F.floor("rate").cast("long") + F.coalesce((_place(F.col("rate")) < F.col("edge")).cast("long"), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken (copies * size)."""
    x = stash(docs.select(docs[id_col].cast("long").alias("doc_id"), *_described(docs[id_col], docs[text_col], docs[source_col])), "mix-sizes")
    plan = _plan(x, weights, share, cap)
    z = x.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).withColumn("rate", _rate(cap)).withColumn("copies", _copies())
    return z.select("doc_id", "a.source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _edges(y: DataFrame) -> DataFrame:
    """For each source the place below which documents get one more copy: digit by digit, the last bin that still fits into what the target leaves."""
    state = y.groupBy("sid").agg((F.max("target") - F.sum(F.col("base") * F.col("size"))).alias("left")).withColumn("prefix", F.lit(0).cast("long"))
    state = stash(state, "mix-edges")
    for level in (2, 1, 0):
        bin_ = F.shiftright("place", level * DIGIT)
        held = y.where("place is not null").select("sid", "size", bin_.alias("bin"))
        bins = held.groupBy("sid", "bin").agg(F.sum("size").alias("words"))  # at most 1024 of interest a source
        bins = bins.join(state, "sid").where(F.shiftright("bin", DIGIT) == F.col("prefix"))
        upto = F.sum("words").over(W.partitionBy("sid").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
        cut = bins.withColumn("upto", upto).where(F.col("upto") <= F.col("left")).groupBy("sid").agg(F.max("bin").alias("last"), F.max("upto").alias("used"))
        state = state.join(cut, "sid", "left").select(
            "sid",
            (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
            F.coalesce(F.col("last") + 1, F.shiftleft("prefix", DIGIT)).alias("prefix"),
        )
        state = stash(state, "mix-edges")
    return state.select("sid", F.col("prefix").alias("edge"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix itself: the columns of docs, each document as often as it is taken."""
    own = _described(docs[id_col], docs[text_col], docs[source_col])
    plan = _plan(stash(docs.select(own), "mix-sizes"), weights, share, cap)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *own)
    z = whole.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).withColumn("rate", _rate(cap)).withColumn("copies", _copies())
    return z.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
