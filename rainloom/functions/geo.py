"""Geometry of tracks and grids as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres a degree of latitude.
DEGREE_KM = 111.32


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; the longitude difference wraps, and rounding can't push the sine beyond 1.

    The difference is wrapped with the roundings of the registered SQL, since these decide which of two mirrored places is nearer."""
    turn = F.lit(360.0)
    dlat, dlon = F.radians(lat2 - lat1), F.radians(((lon2 - lon1 + 180) % turn + 360) % turn - 180)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # not least(), which skips nulls


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, 0 = north, 90 = east."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def wrap180(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def wrap360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def local_km(lon: Column, lat: Column, lon0: Column, lat0: Column, degree_km: float = DEGREE_KM) -> tuple[Column, Column]:
    """(east, north) on the plane that touches at (lon0, lat0)."""
    return wrap180(lon - lon0) * degree_km * F.cos(F.radians(lat0)), (lat - lat0) * degree_km


def to_storm_axes(east: Column, north: Column, heading: Column) -> tuple[Column, Column]:
    """(ahead, left) of a storm that moves along heading."""
    t = F.radians(heading)
    return east * F.sin(t) + north * F.cos(t), -east * F.cos(t) + north * F.sin(t)


def from_storm_axes(ahead: Column, left: Column, heading: Column) -> tuple[Column, Column]:
    t = F.radians(heading)
    return ahead * F.sin(t) - left * F.cos(t), ahead * F.cos(t) + left * F.sin(t)


def cell_area_km2(lat: Column, degrees: float) -> Column:
    return (DEGREE_KM * degrees) ** 2 * F.cos(F.radians(lat))


def equivalent_radius(area: Column) -> Column:
    return F.sqrt(area / math.pi)


def angle_difference(a: Column, b: Column) -> Column:
    """a - b in [-180, 180)."""
    return wrap180(a - b)


def in_front(a: Column, b: Column) -> Column:
    return (F.abs(angle_difference(a, b)) <= 90).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """(sine, cosine) of a value of a cycle."""
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def season(month: Column) -> Column:
    return F.when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn").when(month.isin(12, 1, 2), "winter")


def coast_kernel(distance: Column, scale: float = 200.0) -> Column:
    return F.exp(-F.abs(distance) / scale)


def coast_flags(distance: Column, near: float = 100.0, wide: float = 300.0) -> dict[str, Column]:
    """Signed distance to the coast, negative on land. Unknown distances give 0, not null."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {"is_near_coast": flag(F.abs(distance) <= near), "is_near_coast_wide": flag(F.abs(distance) <= wide), "is_far_offshore": flag(distance > wide), "is_inland": flag(distance < -near)}


#: Radius of the sphere of web maps, and the latitude at which their square ends.
MERCATOR_M, MERCATOR_LAT = 6378137.0, 85.051128779806604


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north on the spherical Mercator plane; latitudes beyond the square are pulled in to its edge."""
    held = F.greatest(F.lit(-MERCATOR_LAT), F.least(F.lit(MERCATOR_LAT), lat))
    return F.radians(lon) * MERCATOR_M, F.when(lat.isNotNull(), F.log(F.tan(F.radians(held) / 2 + math.pi / 4)) * MERCATOR_M)


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude of a place on the plane."""
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2)
