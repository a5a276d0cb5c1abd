"""Land and coasts as tables of segments (poly, x1, y1, x2, y2 in degrees): tests, rasters and distances as equi-joins by grid cell.

Rings may reach beyond 180 degrees either way; places are taken modulo 360. Answers belong to places (x, y) and not to keys, so rows that repeat a
key are told apart; the parameter key is there for callers that name one, and isn't read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.geo import local_km, wrap180


def segments(vertices: DataFrame, poly: str = "poly", order: str = "i", x: str = "x", y: str = "y") -> DataFrame:
    """The closed rings of vertices (poly, i, x, y) as segments: each vertex to the next of its ring, the last to the first."""
    n = vertices.groupBy(poly).agg(F.max(order).alias("__last"))
    a = vertices.join(n, poly).withColumn("__next", F.when(F.col(order) == F.col("__last"), F.lit(0)).otherwise(F.col(order) + 1))
    b = vertices.select(F.col(poly).alias("__p"), F.col(order).alias("__next_of"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    return a.join(b, (F.col(poly) == F.col("__p")) & (F.col("__next") == F.col("__next_of"))).select(poly, F.col(x).alias("x1"), F.col(y).alias("y1"), "x2", "y2")


def shape_segments(vertices: DataFrame) -> DataFrame:
    """Segments of the vertices that sources.polygons reads. poly is the record: its holes belong to it, and parity over all of its rings leaves them out. Lines stay open."""
    part = Window.partitionBy("path", "record", "part")
    place = part.orderBy("i")
    whole = part.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(place), F.when(F.col("kind") != "line", F.first(c).over(whole)))
    x = vertices.where(F.col("error").isNull()).withColumns({"x2": after("x"), "y2": after("y"), "n": F.count("*").over(part)})
    return x.where("x2 is not null and n > 1").select(F.concat_ws(":", "path", "record").alias("poly"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", "kind")


def distinct_outlines(segments: DataFrame) -> DataFrame:
    """(poly, x1, y1, x2, y2): the segments of one polygon, that of the smallest id, of each outline. Polygons of equal segments hold the same places, so that copies need no search of their own."""
    ends = ["x1", "y1", "x2", "y2"]
    outline = segments.groupBy("poly").agg(F.sort_array(F.collect_list(F.struct(*ends))).alias("__s")).groupBy("__s").agg(F.min("poly").alias("poly"))
    return outline.select("poly", F.explode("__s").alias("s")).select("poly", *[f"s.{c}" for c in ends])


def _bands(a: Column, b: Column, size: float, margin: Column | float = 0.0) -> tuple[Column, Column]:
    return F.floor((F.least(a, b) - margin) / size).cast("long"), F.floor((F.greatest(a, b) + margin) / size).cast("long")


def _crossing(y: Column) -> tuple[Column, Column]:
    """Whether a segment crosses the parallel y, and where."""
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    return (F.col("y1") > y) != (F.col("y2") > y), at


def _answered(points: DataFrame, answers: DataFrame, x: str, y: str) -> DataFrame:
    """points with the columns of answers (__x, __y, ...), by place."""
    return points.join(answers, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left").drop("__x", "__y")


def on_land(points: DataFrame, segments: DataFrame, key: str | None = None, x: str = "lon", y: str = "lat", band: float = 1.0) -> DataFrame:
    """points with on_land: whether any polygon holds the point, by the parity of the segments that a ray to the east crosses.

    Segments are filed under each band of latitude that they cross, so a point meets those of its own band only; it meets them at its own longitude and at
    the one a turn away, for rings that reach over the date line. Without a place it is false."""
    lo, hi = _bands(F.col("y1"), F.col("y2"), band)
    filed = distinct_outlines(segments).withColumn("__band", F.explode(F.sequence(lo, hi)))
    own = F.when(F.col("__x").between(-180, 180), F.col("__x")).otherwise(wrap180(F.col("__x")))
    turns = F.explode(F.array(own, F.when(own < 0, own + 360).otherwise(own - 360)))
    p = points.select(F.col(x).alias("__x"), F.col(y).alias("__y")).dropna().distinct().withColumn("__at", turns).withColumn("__band", F.floor(F.col("__y") / band).cast("long"))
    crosses, where = _crossing(F.col("__y"))
    odd = p.join(filed, "__band").where(crosses & (F.col("__at") < where)).groupBy("__x", "__y", "__at", "poly").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return _answered(points, odd.select("__x", "__y").distinct().withColumn("on_land", F.lit(True)), x, y).withColumn("on_land", F.coalesce("on_land", F.lit(False)))


def land_cells(segments: DataFrame, cell: float = 0.05, touched: bool = False) -> DataFrame:
    """(irow, icol): the cells of a raster whose centres ((icol + 0.5) * cell, (irow + 0.5) * cell) lie on land; with touched also those that a segment enters.

    Rows of cells are filled in parallel: a segment gives its crossing with the centre line of each row, and between the 1st and 2nd, the 3rd and 4th ... crossing
    of a polygon the row is land. Columns are counted from -180 degrees round the earth. A row holds as many crossings of a polygon as its outline has there."""
    lo, hi = _bands(F.col("y1"), F.col("y2"), cell)
    rows = distinct_outlines(segments).withColumn("irow", F.explode(F.sequence(lo - 1, hi + 1)))
    crosses, where = _crossing((F.col("irow") + 0.5) * cell)
    w = Window.partitionBy("poly", "irow").orderBy("__at")
    spans = rows.where(crosses).select("poly", "irow", where.alias("__at")).withColumns({"__n": F.row_number().over(w), "__to": F.lead("__at").over(w)}).where("__n % 2 = 1")
    centre = (F.col("icol") + 0.5) * cell
    a, b = _bands(F.col("__at"), F.col("__to"), cell)
    cells = spans.withColumn("icol", F.explode(F.sequence(a - 1, b + 1))).where((centre >= F.col("__at")) & (centre < F.col("__to"))).select("irow", "icol")
    if touched:
        low, high = F.col("irow") * cell, (F.col("irow") + 1) * cell
        dy = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
        held = lambda y: F.greatest(F.least(F.col("x1"), F.col("x2")), F.least(F.greatest(F.col("x1"), F.col("x2")), F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / dy))
        start, end = F.when(dy.isNull(), F.col("x1")).otherwise(held(low)), F.when(dy.isNull(), F.col("x2")).otherwise(held(high))
        inside = (F.greatest("y1", "y2") >= low) & (F.least("y1", "y2") < high)
        c, d = _bands(start, end, cell)
        cells = cells.unionByName(rows.where(inside).select("irow", F.explode(F.sequence(c, d)).alias("icol")))
    n = round(360 / cell)
    return cells.select("irow", (F.pmod(F.col("icol") + n // 2, F.lit(n)) - n // 2).alias("icol")).distinct()


def store_land(cells: DataFrame, path: str, cell: float = 0.05, band: float = 10.0) -> None:
    """Write the raster's cells in folders by bands of latitude, so that places of few bands read few folders."""
    cells.withColumn("band", F.floor((F.col("irow") + 0.5) * cell / band).cast("int")).repartition("band").write.mode("overwrite").partitionBy("band").parquet(path)


def in_cells(points: DataFrame, cells: DataFrame, cell: float = 0.05, x: str = "lon", y: str = "lat") -> DataFrame:
    """points with on_land: whether the raster has their cell. An equi-join by cell, of the distinct cells that points are in."""
    at = points.withColumns({"__r": F.floor(F.col(y) / cell).cast("long"), "__c": F.floor(wrap180(F.col(x)) / cell).cast("long")})
    land = cells.select(F.col("irow").alias("__r"), F.col("icol").alias("__c")).distinct().withColumn("on_land", F.lit(True))
    return at.join(land, ["__r", "__c"], "left").withColumn("on_land", F.coalesce("on_land", F.lit(False))).select(*points.columns, "on_land")


def _to_segment(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of the origin to the segment from (ax, ay) to (bx, by) on a plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(length, F.lit(0.0))))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def segment_km(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment on the local plane about the point."""
    return _to_segment(*local_km(x1, y1, x, y), *local_km(x2, y2, x, y))


def coast_distance(points: DataFrame, segments: DataFrame, key: str | None, reach_km: float, x: str = "lon", y: str = "lat", cell: float = 2.0) -> DataFrame:
    """points with coast_km: the distance to the nearest segment within reach_km; null beyond.

    Segments are filed under every cell that their box and the reach touch, round the earth and widened by their own latitude; a point meets those of its own
    cell. cell must divide 360. Near the poles, where the reach spans all longitudes, a segment is filed under all columns of its rows."""
    n = round(360 / cell)
    if abs(n * cell - 360) > 1e-9:
        raise ValueError("cell must divide 360 degrees")
    north = reach_km / 111.0
    lat = F.greatest(F.abs("y1"), F.abs("y2")) + north
    margin = F.when(lat >= 89.0, 360.0).otherwise(north / F.cos(F.radians(F.least(lat, F.lit(89.0)))))
    r0, r1 = _bands(F.col("y1"), F.col("y2"), cell, north)
    c0, c1 = _bands(F.col("x1"), F.col("x2"), cell, margin)
    column = F.explode(F.sequence(c0, F.least(c1, c0 + n - 1)))
    filed = segments.select("x1", "y1", "x2", "y2").distinct().withColumn("__r", F.explode(F.sequence(r0, r1))).withColumn("__c", column).withColumn("__c", F.pmod("__c", F.lit(n)))
    p = points.select(F.col(x).alias("__x"), F.col(y).alias("__y")).dropna().distinct()
    p = p.withColumns({"__r": F.floor(F.col("__y") / cell).cast("long"), "__c": F.pmod(F.floor(F.col("__x") / cell).cast("long"), F.lit(n))})
    km = segment_km(*(F.col(c) for c in ("__x", "__y", "x1", "y1", "x2", "y2")))
    near = p.join(filed, ["__r", "__c"]).groupBy("__x", "__y").agg(F.min(km).alias("coast_km")).where(F.col("coast_km") <= reach_km)
    return _answered(points, near, x, y)


def plane_distance(points: DataFrame, segments: DataFrame, reach: float, x: str, y: str, cell: float) -> DataFrame:
    """points with coast_m: the distance on a plane (x, y and the segments in its metres, e.g. from geo.mercator) to the nearest segment within reach; null beyond."""
    r0, r1 = _bands(F.col("y1"), F.col("y2"), cell, reach)
    c0, c1 = _bands(F.col("x1"), F.col("x2"), cell, reach)
    filed = segments.select("x1", "y1", "x2", "y2").distinct().withColumn("__r", F.explode(F.sequence(r0, r1))).withColumn("__c", F.explode(F.sequence(c0, c1)))
    p = points.select(F.col(x).alias("__x"), F.col(y).alias("__y")).dropna().distinct()
    p = p.withColumns({"__r": F.floor(F.col("__y") / cell).cast("long"), "__c": F.floor(F.col("__x") / cell).cast("long")})
    m = _to_segment(F.col("x1") - F.col("__x"), F.col("y1") - F.col("__y"), F.col("x2") - F.col("__x"), F.col("y2") - F.col("__y"))
    near = p.join(filed, ["__r", "__c"]).groupBy("__x", "__y").agg(F.min(m).alias("coast_m")).where(F.col("coast_m") <= reach)
    return _answered(points, near, x, y)
