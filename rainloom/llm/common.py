"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Seconds between two collections of the driver's garbage.
COLLECT_EVERY = 10.0
_collected = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). A temporary one is taken only where that is unset and the master is local, as in tests: the
    executors of a cluster wouldn't see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="rainloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, once in COLLECT_EVERY seconds at most: plans, task metrics and map outputs of finished jobs go, and with them Spark
    cleans up their broadcasts and shuffle files. Spark itself asks for this every half hour (spark.cleaner.periodicGC.interval, which a running session
    can't change); until then jobs of many small tasks widen the driver's heap up to its limit."""
    global _collected
    if time.monotonic() - _collected >= COLLECT_EVERY:
        spark._jvm.System.gc()
        _collected = time.monotonic()


def stash(df: DataFrame, label: str, **facts: Column) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage is cut, and a lost executor costs no recomputation. facts:
    aggregates taken while writing, found in the result's `facts`. What earlier jobs left on the driver is released."""
    path = f"{shared_dir(df.sparkSession)}/rainloom/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    watched = df.observe(seen, *[c.alias(k) for k, c in facts.items()]) if facts else df
    watched.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at, out.facts = path, seen.get if facts else {}
    release(df.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
