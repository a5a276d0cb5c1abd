"""What finished jobs leave on the driver is given back while a chain of stashed tables is still under way."""

import gc

from pyspark.sql import functions as F

from rainloom.llm import common


def left_behind(spark):
    """A weak reference to the plans of a job with a shuffle that nothing needs any more."""
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    df.collect()
    return spark._jvm.java.lang.ref.WeakReference(df._jdf.queryExecution())


def test_stash_releases_finished_jobs(spark, monkeypatch):
    monkeypatch.setattr(common, "COLLECT_EVERY", 0.0, raising=False)
    old = left_behind(spark)
    gc.collect()
    out = common.stash(spark.range(10).toDF("id"), "release", n=F.count(F.lit(1)))
    common.stash(out, "release")  # the listeners have seen the end of the first by now
    assert old.get() is None
    assert out.facts["n"] == 10 and out.count() == 10


def test_collections_are_rare(spark, monkeypatch):
    monkeypatch.setattr(common, "COLLECT_EVERY", 3600.0)
    common._collected = common.time.monotonic()
    before = common._collected
    common.stash(spark.range(10).toDF("id"), "release")
    assert common._collected == before
