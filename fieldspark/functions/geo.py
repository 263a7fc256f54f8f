"""Boxes, longitudes, local metres, pixels and tiles. Boxes are (west, south, east, north), ends included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii, and kilometres per degree of longitude at the equator and of latitude.
EARTH_RADIUS_M = 6.371e6
EARTH_RADIUS_KM = 6371.0
AREA_RADIUS_KM = 6371.0088
SQKM_PER_SQMI = 2.589988110336
KM_PER_DEG_LON = 111.32
KM_PER_DEG_LAT = 110.57


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def in_box(lon: Column, lat: Column, west, south, east, north) -> Column:
    return (lon >= _c(west)) & (lon <= _c(east)) & (lat >= _c(south)) & (lat <= _c(north))


def overlaps(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    """The two boxes share at least a point."""
    return (_c(w1) <= _c(e2)) & (_c(e1) >= _c(w2)) & (_c(s1) <= _c(n2)) & (_c(n1) >= _c(s2))


def contains(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    """The first box contains the second."""
    return (_c(w1) <= _c(w2)) & (_c(s1) <= _c(s2)) & (_c(e1) >= _c(e2)) & (_c(n1) >= _c(n2))


def in_box_but_corner(lon, lat, west, south, east, north, corner_lon, corner_lat) -> Column:
    """In the box, but not in the corner west of `corner_lon` and north of `corner_lat` (a model's domain may
    leave one corner out)."""
    return in_box(lon, lat, west, south, east, north) & ~((lon < _c(corner_lon)) & (lat > _c(corner_lat)))


def box_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Degrees squared; null bounds (an unbounded domain) rank last as infinity."""
    return F.coalesce((east - west) * (north - south), F.lit(float("inf")))


def wrap_lon(lon: Column) -> Column:
    """To -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def wrap_360(lon: Column) -> Column:
    """To 0..360."""
    return F.pmod(lon, F.lit(360.0))


def seam_filter(lon: Column, west: Column | float, east: Column | float, low: float = -180.0) -> Column:
    """lon inside west..east, all wrapped to low..low+360; a box across the seam becomes two ranges."""
    def wrap(x: Column) -> Column:
        return F.pmod(x - low, F.lit(360.0)) + low

    x, w, e = wrap(lon), wrap(_c(west)), wrap(_c(east))
    return F.when(w > e, (x >= w) | (x <= e)).otherwise((x >= w) & (x <= e))


def to_local(lon: Column, lat: Column, lon0, lat0) -> tuple[Column, Column]:
    """Plane coordinates in metres around a point: degrees times the arc of one, longitudes shortened by the point's own latitude."""
    x = F.radians(lon - _c(lon0)) * F.cos(F.radians(_c(lat0))) * EARTH_RADIUS_M
    y = F.radians(lat - _c(lat0)) * EARTH_RADIUS_M
    return x, y


def from_local(x: Column, y: Column, lon0, lat0) -> tuple[Column, Column]:
    lon = _c(lon0) + F.degrees(x / (F.cos(F.radians(_c(lat0))) * EARTH_RADIUS_M))
    lat = _c(lat0) + F.degrees(y / EARTH_RADIUS_M)
    return lon, lat


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2.0 * EARTH_RADIUS_KM)


def distance_to_box_km(lon: Column, lat: Column, west, south, east, north) -> Column:
    """Great-circle distance to the nearest point of the box, 0 inside."""
    near_lon = F.least(F.greatest(lon, _c(west)), _c(east))
    near_lat = F.least(F.greatest(lat, _c(south)), _c(north))
    return great_circle_km(lon, lat, near_lon, near_lat)


def planar_km(lon: Column, lat: Column, plon: Column, plat: Column) -> Column:
    """Distance of a cell from a point with the point's own cosine of latitude."""
    dx = (lon - plon) * KM_PER_DEG_LON * F.cos(F.radians(plat))
    dy = (lat - plat) * KM_PER_DEG_LAT
    return F.hypot(dx, dy)


def to_pixel(lon: Column, lat: Column, box: tuple[float, float, float, float], width: int, height: int):
    """Continuous pixel position (x right, y down) on a raster of the box and the pixel that holds it."""
    west, south, east, north = box
    x = (lon - west) * (width / (east - west))
    y = (F.lit(north) - lat) * (height / (north - south))
    return x, y, F.floor(x).cast("int"), F.floor(y).cast("int")


def tile(x: Column, size: float) -> Column:
    """Index of the tile of the given size that holds x."""
    return F.floor(x / size).cast("long")


# The smallest tile side in degrees (about 7 m of latitude); each level doubles it.
FINEST_TILE = 2.0**-14


def box_level(width: Column, height: Column) -> Column:
    """The first level whose tiles are at least as large as the box, so that the box touches four at most."""
    steps = F.ceil(F.log2(F.greatest(width, height) / FINEST_TILE)).cast("int")
    return F.greatest(F.lit(0), F.coalesce(steps, F.lit(0)))


def level_size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level) * FINEST_TILE


def level_tile(x: Column, level: Column) -> Column:
    return F.floor(x / level_size(level)).cast("long")


def tile_range(low: Column, high: Column, size: float) -> Column:
    """All tile indices that [low, high] touches."""
    return F.sequence(tile(low, size), tile(high, size))


def barycentric(px, py, x0, y0, x1, y1, x2, y2) -> tuple[Column, Column, Column]:
    """Weights of point p on the three vertices of a triangle."""
    det = (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)
    b0 = ((y1 - y2) * (px - x2) + (x2 - x1) * (py - y2)) / det
    b1 = ((y2 - y0) * (px - x2) + (x0 - x2) * (py - y2)) / det
    return b0, b1, F.lit(1.0) - b0 - b1


def triangle_area_m2(lon, lat) -> Column:
    """Area of a triangle from its three longitudes and latitudes, in metres about its own mean latitude."""
    kx = F.cos(F.radians((lat[0] + lat[1] + lat[2]) / 3.0)) * EARTH_RADIUS_M
    x = [F.radians(v) * kx for v in lon]
    y = [F.radians(v) * EARTH_RADIUS_M for v in lat]
    return F.abs((x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])) * 0.5


def ring_segment(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """One edge's term of the spherical ring sum."""
    return F.radians(lon2 - lon1) * (F.lit(2.0) + F.sin(F.radians(lat1)) + F.sin(F.radians(lat2)))


def ring_area_km2(total: Column) -> Column:
    return F.abs(total) * (AREA_RADIUS_KM * AREA_RADIUS_KM / 2.0)
