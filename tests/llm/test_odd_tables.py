"""All operators and stages on nulls in every column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rainloom.llm import leaks, mixing, neardup, passages, pii, quality, secrets, tokens, urls, warc
from rainloom.llm.common import shared_dir
from rainloom.llm.queries import KEY, vocabulary

#: Names that the operators use within.
CLASH = ["id", "n", "key", "copies", "removed", "row", "i", "k", "bucket", "size", "rate", "place", "part", "w", "one", "root", "class_id", "component_id", "sid", "target", "text_key", "a", "b", "hit", "score", "kept", "value", "kind", "record_id", "sha256", "payload", "features", "label", "suffix", "fold", "__own", "__key", "__new"]

_rng = random.Random(1)
_prose = " ".join(_rng.choice("bcdfg") + str(_rng.randrange(500)) for _ in range(120))
TEXTS = [None, "", " \n\t ", "one", _prose, _prose, _prose + " more", "x" * 1_000_000, "word " * 200_000, "é 漢字 🎉 %E9 \\u0041 a@b.co " * 20, "a\x00b\x85c", "Mr. John Smith, x@y.co, +1 (743) 555-3824"]
IDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]


def table(spark, rows, id_col="doc_id", text_col="text", more=()):
    """Rows (id, text, …) with nulls in each column, repeated rows, one id with two texts, and a column for every clashing name."""
    names = [id_col, text_col, *more]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == id_col else 'string'}" for n in names))
    return df.withColumns({c: F.lit("clash") if j % 2 else F.lit(None).cast("string") for j, c in enumerate(CLASH)})


def documents(spark):
    rows = [(i, t, ("s1", "s2", None)[i % 3]) for i, t in zip(IDS, TEXTS, strict=True)]
    rows += [(None, _prose, "s1"), (None, None, None), (5, _prose, "s2"), (5, "another text of id five", "s2"), (1, None, None)]
    return table(spark, rows, more=("source",))


def pages(spark):
    urls_ = [None, "", "http://a.com/en/x", "http://a.com/en/x", "no scheme", "http://x/" + "y" * 1_000_000, "http://n.net/de/1", "http://é.org/es/\r\n", "x://y", "http://a.b/?q=1", "s://h", "http://z.com/en/"]
    return table(spark, [*zip(IDS, TEXTS, urls_, strict=True), (None, _prose, None), (5, _prose, "http://a.com/en/x")], "page_id", "html", ("url",))


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, None), (None, 1, 0), (6, None, 1), (10, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


def bench(spark):
    return table(spark, [(1, " ".join(_prose.split()[20:60])), (1, None), (None, "x y"), (2, ""), (3, "never seen " * 9)], "item_id").drop("answer")


OPERATORS = {
    "op1": (documents, lambda s, d: quality.judge_quality(d, labels(s)), True),
    "op2": (pages, lambda s, d: warc.archive_report(d), True),
    "op3": (documents, lambda s, d: tokens.count_tokens(d, vocabulary("byte_bpe_50k.json"), chunk=50_000), True),
    "op4": (documents, lambda s, d: pii.replace_entities(d, KEY, marks=True), True),
    "op5": (documents, lambda s, d: mixing.mix(d), True),
    "op6": (documents, lambda s, d: passages.repeats(d), False),
    "op6 removed": (documents, lambda s, d: passages.remove_repeats(d), True),
    "op7": (documents, lambda s, d: leaks.find_leaks(d, bench(s)), False),
    "op8": (pages, lambda s, d: urls.judge_urls(d), True),
    "op9": (documents, lambda s, d: neardup.group_documents(d), True),
    "op10": (documents, lambda s, d: secrets.scan_documents(d), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_odd_tables(spark, name):
    make, run, row_by_row = OPERATORS[name]
    df = make(spark)
    out = run(spark, df).collect()
    if row_by_row:
        assert len(out) == df.count()
    elif name == "op6":  # of equal rows neither is a copy; a null id ranks last
        assert {(r.doc_id, r.first_doc_id) for r in out} == {(6, 5), (7, 5), (None, 5), (9, 9), (10, 10)}
    else:
        assert {(r.doc_id, r.item_id) for r in out} == {(5, 1), (6, 1), (7, 1), (None, 1)}
    if name == "op9":
        kept = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out)
        assert kept.count((5, 5, True)) == 3 and (6, 5, False) in kept and (7, 5, False) in kept and (0, 5, False) in kept
    if name == "op5":
        assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert run(spark, df.limit(0)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = documents(spark)
    out = stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    rows = [(r.doc_id, r.text) for r in out.collect()]
    if name == "near-duplicates":
        assert len([1 for _, t in rows if t and t.startswith(_prose)]) == 1 and (5, _prose) in rows and (5, "another text of id five") in rows
    if name == "decontamination":
        assert not [1 for _, t in rows if t and t.startswith(_prose)] and len(rows) == df.count() - 5
    if name == "personal data":
        assert len(rows) == df.count() and not [1 for _, t in rows if t and "John" in t]
    if name == "mixing":
        assert (None, _prose) in rows  # 150 % of all words: a row without an id is taken too
    assert stage(spark, df.limit(0), str(tmp_path)).collect() == []


def test_shared_folder_must_be_named(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        shared_dir(Elsewhere)
