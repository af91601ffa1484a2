"""Position expressions: local tangent plane and Web-Mercator tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolake.functions.fixed import EARTH_RADIUS_M, MERCATOR_MAX_LAT


def east_m(lon: Column, lat0: Column, lon0: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat0)) * F.radians(lon - lon0)


def north_m(lat: Column, lat0: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lat - lat0)


def latitude(north: Column, lat0: Column) -> Column:
    return lat0 + F.degrees(north / EARTH_RADIUS_M)


def longitude(east: Column, lat0: Column, lon0: Column) -> Column:
    return lon0 + F.degrees(east / (F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat0))))


def planar_distance(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    return F.hypot(east_m(lon, lat0, lon0), north_m(lat, lat0))


def _clamp_index(value: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), value.cast("bigint")))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return _clamp_index((lon + 180.0) / 360.0 * n, n)


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    limited = F.greatest(F.least(lat, F.lit(MERCATOR_MAX_LAT)), F.lit(-MERCATOR_MAX_LAT))
    return _clamp_index((F.lit(1.0) - F.asinh(F.tan(F.radians(limited))) / F.pi()) / 2.0 * n, n)


def tile_west(x: Column, zoom: int) -> Column:
    return x / float(1 << zoom) * 360.0 - 180.0


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - 2.0 * y / float(1 << zoom)))))


def tile_bounds(x: Column, y: Column, zoom: int) -> Column:
    return F.struct(
        tile_west(x, zoom).alias("lon_w"), tile_north(y, zoom).alias("lat_n"),
        tile_west(x + 1, zoom).alias("lon_e"), tile_north(y + 1, zoom).alias("lat_s"))


def tiles_covering(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """Array of (x, y) structs of all tiles that touch the box."""
    xa, ya = tile_x(west, zoom), tile_y(north, zoom)
    xb, yb = tile_x(east, zoom), tile_y(south, zoom)
    xs = F.sequence(F.least(xa, xb), F.greatest(xa, xb))
    ys = F.sequence(F.least(ya, yb), F.greatest(ya, yb))
    return F.flatten(F.transform(xs, lambda x: F.transform(
        ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
