"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

1. Sketch: the set of word shingles of each whole text, its digest and its SuperMinHash signature. SuperMinHash gives element number i
   a uniform r and a place in a random permutation at every rank j; slot l of the signature is the smallest r + j that any
   element put there. Ranks are worked off level by level for all elements at once, and end early: a level above all slots can
   change nothing.
2. Documents of equal sets are one class, known by the 128-bit digest of the set; one row stands for it from here on.
3. Banding: classes that share a band share a bucket. In each bucket every class is paired with one leader, the class that
   shares most buckets with others, so a bucket of n classes makes n - 1 pairs and a large group the same few leaders throughout.
4. Verification: pairs whose signatures agree far below the threshold go; the others are compared on their full sets.
5. Grouping: links become components by alternating large-star and small-star steps, all on tables.
6. Completion: a class may share a bucket with a class of another component that wasn't its leader. Such classes are compared through
   their rarest shingles (two sets of the asked similarity share one of them), members of a shingle's largest component only with those
   outside it, and only where sizes and shared shingles allow a link. So no link between classes with a common bucket is lost.

With the default bands a pair at the threshold shares no bucket with probability below 1e-7; pairs above it more rarely still.

Cases: texts that are null or without words have the empty set and are linked with nothing, not even each other; a text of fewer words than a
shingle is one shingle; rows that repeat an id are judged by their own texts; a null id is linked as any other, but class and component ids are the smallest
ids that aren't null (null only if all are), so a row without an id is kept only where its whole component has none; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rainloom.llm.common import discard, stash

U = np.uint64
#: Stands for a null id where rows are joined.
NO_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes. bytes.lower and bytes.split know ASCII only, as asked for."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, U)
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], U)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, w), U, len(w))
    n = len(w) - size + 1
    x = np.full(n, size, U)
    for k in range(size):
        x = _mix(x * U(0x9E3779B97F4A7C15) + one[k : k + n])
    return np.unique(x)


def _levels(x: np.ndarray, of: np.ndarray, h: np.ndarray) -> None:
    """Put the elements x, which belong to the sets of rows `of`, into the signatures h (a row a set), level by level."""
    m, flat, at = h.shape[1], h.reshape(-1), np.arange(len(x))
    perm, first = None, None
    for j in range(m):
        if j < 4 or not j % 4:  # a level too many changes nothing
            live = np.flatnonzero(h.max(axis=1)[of] >= j)  # else no value of this level or above can be smaller
            if not len(live):
                return
            if len(live) < len(at):
                x, of, at = x[live], of[live], at[live]
        bits = _mix(x + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + (_mix(bits) % U(m - j)).astype(np.int64)
        if j == 0:
            slots = first = k  # the identity with one swap: no table yet
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.int16 if m < 1 << 15 else np.int32), len(first))
                perm[np.arange(len(first)) * m + first] = 0
            spot = at * m + k
            slots = perm[spot]
            perm[spot] = perm[at * m + j]  # place j isn't looked at again
        np.minimum.at(flat, of * m + slots, (bits >> U(11)).astype(np.float64) * 2.0**-53 + j)


def superminhashes(sets: list[np.ndarray], m: int, block: int = 4096) -> np.ndarray:
    """The SuperMinHash signatures (m doubles each) of non-empty sets of 64-bit hashes: small sets together, large ones block by block."""
    h = np.full((len(sets), m), np.inf)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))  # sets of about one size need about as many levels
    rows: list[int] = []
    held = 0
    for i in order:
        if rows and held + len(sets[i]) > block // 2:
            _together(sets, rows, h)
            rows, held = [], 0
        if len(sets[i]) > block // 2:
            for at in range(0, len(sets[i]), block):
                part = sets[i][at : at + block]
                _levels(part, np.zeros(len(part), np.int64), h[i : i + 1])
        else:
            rows.append(i)
            held += len(sets[i])
    if rows:
        _together(sets, rows, h)
    return h


def _together(sets: list[np.ndarray], rows: list[int], h: np.ndarray) -> None:
    own = np.full((len(rows), h.shape[1]), np.inf)
    _levels(np.concatenate([sets[i] for i in rows]), np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows]), own)
    h[rows] = own


def bands_for(similarity: float, rows: int, miss: float = 1e-7) -> int:
    """How many bands of so many rows leave a pair at the similarity without a common bucket with probability below miss."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def _sketches(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    m = rows * bands

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                x = batch.iloc[at : at + 512]
                sets = [shingles(t, size) for t in x["text"]]
                some = [k for k, s in enumerate(sets) if len(s)]
                h = superminhashes([sets[k] for k in some], m)
                bits = h.view(U)
                acc = np.tile(np.arange(1, bands + 1, dtype=U), (len(some), 1))
                for c in range(rows):
                    acc = _mix(acc * U(0x9E3779B97F4A7C15) + bits[:, c::rows])
                low = (_mix(bits) & U(255)).astype(np.uint8)
                keys, groups, sketch = [None] * len(x), [None] * len(x), [None] * len(x)
                for row, k in enumerate(some):
                    keys[k], groups[k], sketch[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), acc[row].view(np.int64), low[row].tobytes()
                yield pd.DataFrame({"doc_id": x["doc_id"], "text_key": x["text_key"], "n": [len(s) for s in sets], "key": keys, "bands": groups, "sketch": sketch})

    # A null id must not turn the others into doubles, which hold whole numbers up to 2**53 only.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text_key", "text")
    out = texts.mapInPandas(run, "doc_id string, text_key long, n long, key binary, bands array<long>, sketch binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, shingles): the full set of each text, under its digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                found = [shingles(t, size) for t in batch["text"].iloc[at : at + 512]]
                yield pd.DataFrame({"id": [xxhash.xxh3_128_digest(x.tobytes()) for x in found], "shingles": [x.view(np.int64) for x in found]})

    return texts.select("text").mapInPandas(run, "id binary, shingles array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links (a, b): the smallest id of its connected component. Large-star and small-star steps alternate until nothing moves,
    told by the number of edges and two checksums over them that each round's own job brings along."""
    u, v = F.col("u"), F.col("v")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges.stashed_at, before = None, None
    marks = {"n": F.count(F.lit(1)), "one": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), "two": F.bit_xor(F.xxhash64("v", F.lit("two"), "u"))}
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.where("v > u").join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(v.alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = stash(small, "edges", **marks)
        if edges.stashed_at:
            discard(edges)
        edges = small
        if small.facts == before:
            break
        before = small.facts
    roots = edges.select(u.alias("id"), v.alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    x = x.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return x.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _agreeing(pairs: DataFrame, reps: DataFrame, m: int, percent: int) -> DataFrame:
    """Without the pairs whose sketches agree more than eight standard deviations below the threshold."""
    s = percent / 100
    least = int(m * s - 8 * math.sqrt(m * s * (1 - s)))

    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([int((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum()) for a, b in zip(x, y, strict=True)], dtype="int64")

    agree = F.pandas_udf(agree, T.LongType())
    two = pairs.join(reps.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("na")), "a").join(reps.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("nb")), "b")
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return two.where(near).where(agree("x", "y") >= least).select("a", "b")


def _crossing(members: DataFrame, sets: DataFrame, percent: int, rare: int = 32, back: int = 64) -> DataFrame:
    """Candidate pairs (a, b) between components: members (id, comp) of buckets with several components, by their rarest shingles.

    Linked sets share a shingle of their prefixes, the rarest few of each. If a shared one is held by at most `rare` members, the pair comes up
    there, among as many. Else both prefixes reach into frequent shingles and share no rare one, so the sets have no more in common than the
    fewer of their frequent shingles (`most`): of a large group of copies only those with hardly a change of their own are left, and these
    mostly are of one component already.

    Members of a shingle's largest component meet only those outside it, and only where sizes and `most` allow a link. A pair comes up at its first
    shared shingle, and again only where none of the `back` shingles before is shared, so that a group of near copies doesn't give each of its pairs many times.

    What joins on a shingle is read from tables, so that adaptive execution can split a frequent one over tasks."""
    s = percent / 100
    least_of = lambda n: F.ceil(F.lit(s) * n - 1e-9)
    x = members.join(sets, "id").select("id", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("tok"))
    held = x.groupBy("tok").agg(F.count("*").alias("df"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("tok", "df")
    own = W.partitionBy("id")
    # only shingles that other components hold too can be shared with one of them
    x = x.join(held, "tok").withColumns({"shared": F.count("*").over(own), "frequent": F.count_if(F.col("df") > rare).over(own), "place": F.row_number().over(own.orderBy("df", "tok"))})
    # the prefix of a set counts its unshared shingles first, which are the rarest of all
    prefix = F.col("place") + F.col("n") - F.col("shared") <= F.col("n") - least_of(F.col("n")) + 1
    most = F.when(F.col("df") <= rare, F.col("shared")).otherwise(F.col("frequent"))
    x = stash(x.where(100 * F.col("shared") >= percent * F.col("n")).where(prefix).select("id", "comp", "n", "tok", "df", most.alias("most")), "rare-shingles")

    sizes = x.groupBy("tok", "comp").agg(F.count("*").alias("c"), F.min("n").alias("least"))
    groups = sizes.groupBy("tok").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.min("least").alias("least"), F.count("*").alias("comps")).where("comps > 1")
    groups = stash(groups.select("tok", "main", "least"), "shingle-groups")
    smallest = F.greatest("least", least_of(F.col("n")))
    reach = percent * (F.col("n") + smallest) <= (100 + percent) * F.col("most")
    here = x.join(groups, "tok").where(reach)  # even the smallest partner must be within reach
    # Rows that `reach` drops belong to no pair that sizes allow, so a pair that they do allow has both rows at its first shared shingle.
    before = F.collect_list("tok").over(own.orderBy("df", "tok").rowsBetween(-back, -1))
    here = stash(here.withColumn("before", before), "shingle-members")
    discard(x, groups)
    outer = here.where("comp <> main").select(F.col("tok").alias("t"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("most").alias("sa"), F.col("before").alias("ba"))
    inner = here.select("tok", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("sb"), "main", F.col("before").alias("bb"))
    once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))
    enough = percent * (F.col("na") + F.col("nb")) <= (100 + percent) * F.least("sa", "sb")
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    first = ~F.arrays_overlap("ba", "bb")
    pairs = outer.join(inner, (F.col("t") == F.col("tok")) & (F.col("ca") != F.col("cb")) & once & enough & near & first)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs.made_of = here
    return pairs


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = 8) -> DataFrame:
    """One row per document: doc_id, text_key (hash of its text), n_shingles, class_id (smallest id of an equal set), n_links (links of its class to other classes), component_id, kept."""
    bands = bands_for(percent / 100, rows)
    m = rows * bands
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))
    sketched = stash(_sketches(texts, shingle, rows, bands), "sketches")
    # Equal sets have equal sketches. The row whose text stands for the class: the smallest id, nulls last.
    row = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("row")
    reps = sketched.where("n > 0").groupBy(F.col("key").alias("id")).agg(F.min("doc_id").alias("class_id"), row, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = stash(reps, "classes")

    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sized = stash(buckets.join(shared, "bucket"), "buckets")
    weight = sized.groupBy("id").agg(F.sum("size").alias("weight"))
    members = stash(sized.join(weight, "id").select("id", "bucket", "weight"), "buckets")
    discard(sized)
    leaders = members.groupBy("bucket").agg(F.max(F.struct("weight", "id")).alias("l")).select("bucket", F.col("l.id").alias("b"))
    pairs = members.join(leaders, "bucket").select(F.col("id").alias("a"), "b").where("a <> b").distinct()

    # Of the texts only one of each class that shares a bucket is read again. The digest of what is read names its class.
    wanted = reps.join(members.select("id").distinct(), "id", "left_semi").select(F.coalesce("row.doc_id", F.lit(NO_ID)).alias("i"), F.col("row.text_key").alias("k"))
    again = texts.join(wanted, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("i")) & (F.col("text_key") == F.col("k")), "left_semi")
    sets = stash(_sets(again, shingle).dropDuplicates(["id"]), "sets")
    links = stash(_verified(_agreeing(pairs, reps, m, percent), sets, percent), "links")
    roots = components(links)

    comp = F.coalesce("root", "id")
    placed = members.join(roots, "id", "left").select("id", "bucket", comp.alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
    open_ = stash(placed.join(mixed, "bucket", "left_semi").select("id", "comp").distinct(), "open", n=F.count(F.lit(1)))
    discard(members)
    classes = reps.select("id", "class_id").join(roots, "id", "left").withColumn("root", comp)
    if open_.facts["n"]:
        crossing = _crossing(open_, sets, percent)
        more = stash(_verified(_agreeing(crossing, reps, m, percent), sets, percent), "links", n=F.count(F.lit(1)))
        discard(crossing.made_of)
        if more.facts["n"]:  # links between components: components of components
            comps = open_.select("id", "comp").distinct()
            two = more.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
            top = components(two.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()).select(F.col("id").alias("root"), F.col("root").alias("top"))
            classes = classes.join(top, "root", "left").withColumn("root", F.coalesce("top", "root"))
            links = links.unionByName(more)
    discard(open_, sets)

    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    smallest = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(degree, "id", "left").join(smallest, "root").select("id", "class_id", "n_links", "component_id")
    out = sketched.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("key").alias("id")).join(classes, "id", "left")
    own = lambda c: F.coalesce(c, "doc_id").alias(c)
    out = out.select("doc_id", "text_key", "n_shingles", own("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that `group_documents` keeps, and of rows that repeat an id (or null) and a text one each. Null texts count as empty ones, and rows without words are kept."""
    text = F.coalesce(docs[text_col], F.lit(""))
    judged = group_documents(docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")), **params).where("kept")
    own = F.coalesce("doc_id", F.lit(NO_ID))
    kept = stash(judged.groupBy(own.alias("i"), F.col("text_key").alias("k"), (F.col("n_shingles") > 0).alias("said")).agg(F.count("*").alias("n")), "kept", again=F.count_if((F.col("n") > 1) & F.col("said")))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    x = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("i"), F.xxhash64(text).alias("k"), text.alias("text"), row)
    more = (F.col("n") > 1) & F.col("said")
    out = x.join(kept.where(~more), ["i", "k"], "left_semi").select("row.*")
    if kept.facts["again"]:
        again = x.join(kept.where(more), ["i", "k"], "left_semi").groupBy("i", "text").agg(F.first("row").alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out
