"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from rainloom.operators import timeseries
from rainloom.streaming import accumulate


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def parts(spark, sf_dir, tmp_path):
    x = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").limit(300)
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(x.schema).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "in"))


def test_windowed_totals(spark, sf_dir, tmp_path):
    stream, batch = parts(spark, sf_dir, tmp_path)
    got = {(r.event_type, r.start): (round(r.total, 6), r.n) for r in run(accumulate.windowed_totals(stream, ["event_type"], "ts", "value"), "complete", "totals").collect()}
    want = {(r.event_type, r.start): (round(r.t, 6), r.n) for r in batch.groupBy("event_type", F.window("ts", "1 hour").start.alias("start")).agg((F.sum("value") * 0.5).alias("t"), F.count("*").alias("n")).collect()}
    assert got == want


def test_motion_stream(spark, sf_dir, tmp_path):
    stream, batch = parts(spark, sf_dir, tmp_path)
    got = sorted((r.user_id, r.ts, None if r.dt_h is None or r.dt_h != r.dt_h else round(r.dt_h, 6)) for r in run(accumulate.motion_stream(stream, "user_id", "ts", "value"), "append", "motion").collect())
    m = timeseries.motion(batch, ["user_id"], ["ts", "value"], "ts", ["value"])
    assert got == sorted((r.user_id, r.ts, None if r.dt_h is None else round(r.dt_h, 6)) for r in m.collect())
