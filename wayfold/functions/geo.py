"""Geographic expressions on columns: tiles, distances, fixed-point keys. All are built-in functions, inside of code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, WEB_LAT = 6_371_000.0, 85.05112878
E7 = 1e7


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def tile_count(z) -> Column:
    """Tiles along one side at zoom z."""
    return F.pow(F.lit(2.0), _c(z))


def pixel_lon(z, x, px, extent=4096) -> Column:
    return (x + px / _c(extent)) / tile_count(z) * 360.0 - 180.0


def pixel_lat(z, y, py, extent=4096) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * (y + py / _c(extent)) / tile_count(z)))))


def tile_x(lon, z) -> Column:
    """Column of a longitude, truncated."""
    return ((_c(lon) + 180.0) / 360.0 * tile_count(z)).cast("long")


def tile_y(lat, z, clamp: bool = True) -> Column:
    """Row of a latitude, truncated; clamped to the latitudes that web tiles reach, if asked for."""
    lat = F.greatest(F.least(_c(lat), F.lit(WEB_LAT)), F.lit(-WEB_LAT)) if clamp else _c(lat)
    r = F.radians(lat)
    return ((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * tile_count(z)).cast("long")


def tile_range(west, south, east, north, z) -> Column:
    """struct<x0, x1, y0, y1> of the tiles that a box touches, inside of the grid."""
    top = tile_count(z).cast("long") - 1
    return F.struct(
        F.greatest(F.lit(0), tile_x(west, z)).cast("long").alias("x0"), F.least(top, tile_x(east, z)).alias("x1"),
        F.greatest(F.lit(0), tile_y(north, z)).cast("long").alias("y0"), F.least(top, tile_y(south, z)).alias("y1"),
    )


def tile_bounds(z, x, y) -> Column:
    """struct<west, south, east, north>."""
    return F.struct(pixel_lon(z, x, F.lit(0)).alias("west"), pixel_lat(z, y + 1, F.lit(0)).alias("south"), pixel_lon(z, x + 1, F.lit(0)).alias("east"), pixel_lat(z, y, F.lit(0)).alias("north"))


def flip_y(z, y) -> Column:
    """Between rows counted from the south and from the north."""
    return tile_count(z).cast("int") - 1 - y


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres between points in degrees, on a sphere."""
    dlat, dlon = F.radians(_c(lat2) - _c(lat1)), F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(_c(lat1))) * F.cos(F.radians(_c(lat2))) * F.pow(F.sin(dlon / 2), 2)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_M)


def fixed(degrees) -> Column:
    """Degrees as E7 integers, halves to even."""
    return F.rint(_c(degrees) * E7).cast("long")


def key_of(value, places: int) -> Column:
    """Integer key of a coordinate rounded to decimal places, halves to even: safe to join and group by."""
    return F.rint(_c(value) * 10.0**places).cast("long")


def cell(e7, scale: int) -> Column:
    """Grid cell of an E7 coordinate, scale cells to a degree, floored (so negatives don't share cell 0)."""
    return F.floor(_c(e7) * scale / E7).cast("long")


def cell_trunc(e7, per_degree: int) -> Column:
    """Grid cell that is truncated towards 0, as the feature grids are."""
    return (_c(e7) / E7 * per_degree).cast("long")


def in_box(lat, lon, box) -> Column:
    """Inside of (west, south, east, north), edges included."""
    west, south, east, north = map(_c, box)
    return lat.between(south, north) & lon.between(west, east)


def representative_point(kind: Column, coords: Column) -> Column:
    """array[lon, lat] for a geometry given as array of parts, each an array of [lon, lat].

    Point: itself; MultiPoint: mean; LineString: its middle vertex; MultiLineString: the middle vertex of its first longest part; Polygon: mean of the
    outer ring's vertices; MultiPolygon: that of its first. Others: null.
    """
    first = F.try_element_at(coords, F.lit(1))
    part = lambda ring, i: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[i]) / F.size(ring)
    mean = lambda ring: F.array(part(ring, 0), part(ring, 1))
    middle = lambda line: F.get(line, F.floor(F.size(line) / 2).cast("int"))
    longest = F.aggregate(coords, F.array().cast("array<array<double>>"), lambda a, line: F.when(F.size(line) > F.size(a), line).otherwise(a))
    return (
        F.when(F.size(coords) < 1, None).when(kind == "Point", F.get(first, F.lit(0))).when(kind == "LineString", middle(first)).when(kind == "MultiLineString", middle(longest))
        .when(kind.isin("MultiPoint", "Polygon", "MultiPolygon"), mean(first))
    )
