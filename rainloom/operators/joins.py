"""Joins that Spark lacks, as equi-joins on buckets or one sorted series, and joins with checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.columns import ContractError
from rainloom.functions.geo import EARTH_KM, haversine_km


def nearest_within(left: DataFrame, right: DataFrame, left_x: str, right_x: str, reach: int, cost: Column, tie: Sequence[str], most: float, key: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the right row of the least cost among those at most `reach` away on x (whole numbers, ends included).

    Rows meet in buckets as wide as the reach: a left row looks into its own bucket and both neighbours, so the join is an equi-join whose
    buckets hold what lies within reach and no more. status is matched, too_far (cost above most) or no_candidate. Column names of both
    sides must differ; key identifies left rows, tie orders equal costs."""
    bucket = lambda x: F.floor(F.col(x) / reach).cast("long")
    a = left.withColumn("__b", F.explode(F.array(*[bucket(left_x) + d for d in (-1, 0, 1)])))
    b = right.withColumn("__b", bucket(right_x))
    near = a.join(b, "__b").where(F.abs(F.col(left_x) - F.col(right_x)) <= reach).withColumn("cost", cost)
    best = near.groupBy(key).agg(F.min_by(F.struct("cost", *carry), F.struct("cost", *tie)).alias("m")).select(key, "m.*")
    status = F.when(F.col("cost").isNull(), "no_candidate").when(F.col("cost") > most, "too_far").otherwise("matched")
    out = left.join(best, key, "left").withColumn("status", status)
    return out.withColumns({c: F.when(F.col("status") == "matched", F.col(c)) for c in carry})


def nearest_value_within(left: DataFrame, right: DataFrame, left_x: str, right_x: str, reach: int, left_v: str, right_v: str, tie: Sequence[str], most: float, key: str, carry: Sequence[str]) -> DataFrame:
    """nearest_within for the cost |left_v - right_v|, without comparing a left row with all right rows of its reach. key names left's rows and isn't read.

    The right rows of a left row's own bucket of x all lie within reach, so the nearest of them in value, from one sorted pass, bounds the cost. Then a left row
    meets the right rows of its own and both neighbouring buckets in the cells of value that the bound touches: cells of powers of four, two at most, so that they hold
    little more than the bound spans. Only left rows without a right row in their own bucket look at all of the neighbouring ones. Rows that repeat x and value are
    looked up once. A value that is null or not a number has no candidate, and is none."""
    bucket = lambda x: F.floor(F.col(x) / reach).cast("long")
    known = lambda v: F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    r = right.where(known(right_v)).groupBy(F.col(right_x).alias("__rx"), F.col(right_v).cast("double").alias("__rv")).agg(F.min(F.struct(*tie)).alias("__tie"), F.min_by(F.struct(*carry), F.struct(*tie)).alias("__carry")).withColumn("__b", bucket("__rx"))
    a = left.where(known(left_v)).select(F.col(left_x).alias("__x"), F.col(left_v).cast("double").alias("__v")).where("__x is not null").distinct().withColumn("__b", bucket("__x"))
    a = nearest_in_series(a, r.select("__b", F.col("__rv").alias("__v")).distinct(), ["__b"], "__v", [])
    wide = F.col("distance") * (1 + 1e-12) + F.abs("__v") * 1e-15  # rounding of the sums below mustn't lose a row
    level = F.when(F.col("distance").isNull(), 9999).when(F.col("distance") == 0, -9999).otherwise(F.ceil(F.log(2 * wide) / math.log(4))).cast("int")
    cell = lambda v: F.when(F.col("__level") == 9999, 0.0).when(F.col("__level") == -9999, v).otherwise(F.floor(v / F.pow(F.lit(4.0), F.col("__level"))).cast("double"))
    a = a.withColumn("__level", level).withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col("__v") - F.when(F.col("__level") == -9999, 0.0).otherwise(wide)), cell(F.col("__v") + F.when(F.col("__level") == -9999, 0.0).otherwise(wide))))))
    a = a.withColumn("__b", F.explode(F.array(*[F.col("__b") + d for d in (-1, 0, 1)])))
    b = r.join(a.select("__b", "__level").distinct(), "__b").withColumn("__cell", cell(F.col("__rv")))
    cost = F.abs(F.col("__v") - F.col("__rv"))
    near = a.join(b, ["__b", "__level", "__cell"]).where((F.abs(F.col("__x") - F.col("__rx")) <= reach) & F.coalesce(cost <= F.col("distance"), F.lit(True))).withColumn("cost", cost)
    best = near.groupBy("__x", "__v").agg(F.min_by(F.struct("cost", *[F.col(f"__carry.{c}").alias(c) for c in carry]), F.struct("cost", "__tie")).alias("m")).select("__x", "__v", "m.*")
    status = F.when(F.col("cost").isNull(), "no_candidate").when(F.col("cost") > most, "too_far").otherwise("matched")
    out = left.join(best, (F.col(left_x) == F.col("__x")) & (F.col(left_v).cast("double") == F.col("__v")), "left").drop("__x", "__v").withColumn("status", status)
    return out.withColumns({c: F.when(F.col("status") == "matched", F.col(c)) for c in carry})


def nearest_in_space(left: DataFrame, right: DataFrame, left_x: str, right_x: str, reach: int, left_place: tuple[str, str], right_place: tuple[str, str], most_km: float, key: str, carry: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Each left row with the nearest right row by great circle among those at most `reach` away on x: columns as nearest_within's, cost in km.

    Rows meet in buckets of both x and place: a left row looks into the cells that a circle of most_km about it can touch, round the earth and, near a pole, in all
    columns, so that a right row is met by the left rows near it and not by all of its time. Only left rows without a match there look at all of
    their time, to tell too_far (with the least distance) from no_candidate. A row without a place matches nothing and is no_candidate. Places are (lon, lat)."""
    (lon, lat), (lon2, lat2) = left_place, right_place
    columns = max(1, int(360.0 / (most_km / 111.0))) if most_km > 0 else 3600
    high, wide = max(most_km, 1e-3) / 111.0, 360.0 / columns
    arc = most_km / EARTH_KM * (1 + 1e-9)
    ratio = math.sin(min(arc, math.pi / 2)) / F.cos(F.radians(lat))
    margin = F.when((F.abs(F.col(lat)) + math.degrees(arc) >= 90) | (ratio >= 1), 360.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    place = lambda x, width: F.floor(x / width).cast("long")
    first = place(F.col(lon) - margin, wide)
    a = left.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    a = a.withColumn("__t", F.explode(F.array(*[place(F.col(left_x), reach) + d for d in (-1, 0, 1)]))).withColumn("__r", F.explode(F.array(*[place(F.col(lat), high) + d for d in (-1, 0, 1)])))
    a = a.withColumn("__c", F.explode(F.sequence(first, F.least(place(F.col(lon) + margin, wide), first + columns - 1)))).withColumn("__c", F.pmod("__c", F.lit(columns)))
    b = right.withColumns({"__t": place(F.col(right_x), reach), "__r": place(F.col(lat2), high), "__c": F.pmod(place(F.col(lon2), wide), F.lit(columns))})
    cost = haversine_km(F.col(lon), F.col(lat), F.col(lon2), F.col(lat2))
    near = a.join(b, ["__t", "__r", "__c"]).where(F.abs(F.col(left_x) - F.col(right_x)) <= reach).withColumn("cost", cost).where(F.col("cost") <= most_km)
    best = near.groupBy(key).agg(F.min_by(F.struct("cost", *carry), F.struct("cost", *tie)).alias("m")).select(key, "m.*").withColumn("status", F.lit("matched"))
    rest = nearest_within(left.join(best.select(key), key, "left_anti"), right.where(F.col(lon2).isNotNull() & F.col(lat2).isNotNull()), left_x, right_x, reach, cost, tie, most_km, key, carry)
    return left.join(best, key).unionByName(rest)


def nearest_in_series(left: DataFrame, right: DataFrame, by: Sequence[str], x: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the columns `carry` of the nearest right row of its series; of two as near, the earlier. distance is |x - x'|.

    Both tables become one sorted series, which is passed over once each way."""
    kept = [c for c in left.columns if c not in by and c != x]
    row = F.struct(F.col(x).alias("x"), *[F.col(c) for c in carry])
    both = right.select(*by, x, row.alias("__t"), F.lit(0).alias("__p")).unionByName(left.select(*by, x, *kept, F.lit(1).alias("__p")), allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy(x, "__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*by).orderBy(F.col(x).desc(), "__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"__a": F.last("__t", ignorenulls=True).over(back), "__c": F.last("__t", ignorenulls=True).over(ahead)}).where("__p = 1")
    da, dc = F.col(x) - F.col("__a.x"), F.col("__c.x") - F.col(x)
    near = F.when(F.col("__c").isNull() | (da <= dc), F.col("__a")).otherwise(F.col("__c"))
    both = both.withColumn("__n", near)
    return both.select(*by, x, *kept, *[F.col(f"__n.{c}").alias(c) for c in carry], F.abs(F.col("__n.x") - F.col(x)).alias("distance"))


def fill_from(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str], right_wins: bool = False) -> DataFrame:
    """left with gaps of its values filled from right (or the reverse): a left join and a coalesce. right must have a row a key at most."""
    r = right.select(*on, *[F.col(v).alias(f"__r_{v}") for v in values])
    out = left.join(r, list(on), "left")
    pick = lambda v: F.coalesce(*((F.col(f"__r_{v}"), F.col(v)) if right_wins else (F.col(v), F.col(f"__r_{v}"))))
    return out.withColumns({v: pick(v) if v in left.columns else F.col(f"__r_{v}") for v in values}).drop(*[f"__r_{v}" for v in values])


def missing_rates(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(v).isNull().cast("int")).alias(v) for v in values])


def assert_unique(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """df, if no two rows share a key."""
    if not df.groupBy(*on).count().where("count > 1").isEmpty():
        raise ContractError(f"{', '.join(on)} isn't unique")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    return assert_unique(left, on).join(assert_unique(right, on), list(on), how)


def differences(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that only one side has, and on which (only_left, only_right). Empty if both hold the same keys."""
    a, b = left.select(*on).distinct().withColumn("__l", F.lit(1)), right.select(*on).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right")
    return a.join(b, list(on), "full_outer").withColumn("side", side).where("side is not null").select(*on, "side")


def replace_columns(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left with the columns of right in place of its own of the same names."""
    new = [c for c in right.columns if c not in on]
    return left.drop(*new).join(right, list(on), "left")


def nearest_to_place(track: DataFrame, places: DataFrame, by: Sequence[str], cost: Column, tie: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """For each place of a key the track row of the same key with the least cost."""
    kept = [c for c in places.columns if c not in by]
    near = track.join(places, list(by)).withColumn("cost", cost)
    return near.groupBy(*by, *kept).agg(F.min_by(F.struct("cost", *carry), F.struct("cost", *tie)).alias("m")).select(*by, *kept, "m.*")


def neighbourhood(points: DataFrame, cells: DataFrame, radius_km: float, spacing_km: float, cell_deg: float, value: str, digits: int = 2, degree_km: float = 111.32) -> DataFrame:
    """points (lon, lat) with the share of sample places within radius_km where value holds, and how many were sampled.

    Sample places lie on a lattice about each distinct rounded point; each falls into one cell of cells (irow, icol, value), an equi-join."""
    n = int(radius_km // spacing_km)
    offsets = [(i * spacing_km, j * spacing_km) for i in range(-n, n + 1) for j in range(-n, n + 1) if (i * i + j * j) * spacing_km**2 <= radius_km**2]
    centre = points.select(F.round("lon", digits).alias("clon"), F.round("lat", digits).alias("clat")).distinct()
    steps = F.array(*[F.struct(F.lit(float(e)).alias("e"), F.lit(float(k)).alias("k")) for e, k in offsets])  # fixed by the radius
    sample = centre.withColumn("o", F.explode(steps))
    lon = F.col("clon") + F.col("o.e") / (degree_km * F.greatest(F.cos(F.radians("clat")), F.lit(1e-6)))
    lat = F.col("clat") + F.col("o.k") / degree_km
    sample = sample.select("clon", "clat", F.floor(lat / cell_deg).cast("long").alias("irow"), F.floor(lon / cell_deg).cast("long").alias("icol"))
    hit = sample.join(cells.select("irow", "icol", F.col(value).cast("double").alias("__v")), ["irow", "icol"], "left")
    stats = hit.groupBy("clon", "clat").agg(F.avg(F.coalesce("__v", F.lit(0.0))).alias(f"{value}_share"), F.count("*").alias("n_sampled"))
    return points.withColumns({"clon": F.round("lon", digits), "clat": F.round("lat", digits)}).join(stats, ["clon", "clat"], "left").drop("clon", "clat")
