"""Few fields with many cells make as many tasks as many fields."""

import pytest
from pyspark.sql import functions as F

from rainloom.operators import calibration


@pytest.mark.parametrize("fields", [1, 3])
def test_cells_of_few_fields_are_shared_out(spark, fields):
    cells = spark.range(4000).select((F.col("id") % fields).alias("k"), F.col("id"), (F.col("id") % 50).cast("double").alias("v"))
    t = cells.select("k").distinct().withColumn("a", F.col("k") + 0.5)
    joined = calibration._beside(cells, t, "k", 32)
    assert joined.columns == ["k", "id", "v", "a"] and joined.where("a = k + 0.5").select("id").distinct().count() == joined.count() == 4000
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        goals = t.select("k", F.lit(60.0).alias("p95"), F.lit(75.0).alias("p99"), F.lit(100.0).alias("top"), F.lit(90.0).alias("cap"))
        sizes = [r["count"] for r in calibration.scale_tail(cells, goals, "k", "v").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 4000 and max(sizes) < 2400  # 4 partitions; one field made one task of all cells


def test_only_cells_of_the_last_value_are_put_in_order(spark):
    n = F.col("id") % 1000
    one, two = F.when(n >= 960, 30.0), F.when(n % 50 == 0, 9.0).otherwise(8.0)
    cells = spark.range(3000).select(F.floor(F.col("id") / 1000).alias("k"), n.alias("i"), "id").withColumn("v", F.when(F.col("k") == 0, F.coalesce(one, (n % 10).cast("double"))).when(F.col("k") == 1, 5.0 + n % 10).otherwise(F.coalesce(one, two))).drop("id")
    goals = spark.createDataFrame([(0, 500.0), (1, 100.0), (2, 500.0)], "k long, area double").select("k", *[F.lit(None).cast("double").alias(c) for c in ("p95", "p99", "top", "cap")], "area")
    out = calibration.calibrate(cells, goals, "k", "v", 1.0, ["i"])
    plan = [x.strip(" :+-") for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    orders = [i for i, x in enumerate(plan) if x.startswith("Window") and "row_number" in x]
    assert orders and all(any("array_contains" in x for x in plan[i + 1 : i + 4]) for i in orders)  # all cells were put in order
    assert not any(x.startswith("Window") and "percentile" in x for x in plan)  # nor are they sorted by field
    moved = {(k, step): {r.i for r in out.where("step is not null").collect() if (r.k, r.step) == (k, step)} for k, step in ((0, "raised"), (1, "lowered"), (2, "raised"))}
    assert out.where("step is not null").count() == 150
    assert moved[0, "raised"] == set(range(9, 509, 10))  # of 96 nines the first 50
    assert moved[1, "lowered"] == set(range(5, 505, 10))  # of 100 tens the first 50
    nines = set(range(0, 960, 50))
    assert moved[2, "raised"] == nines | set([i for i in range(960) if i not in nines][: 50 - len(nines)])
    d = {r.k: r for r in calibration.diagnose(out, "k", "v", 1.0).collect()}
    assert (d[0].n_raised, d[1].n_lowered, d[2].n_raised) == (50, 50, 50) and d[0].area_after == 90 and d[1].area_after == 450
