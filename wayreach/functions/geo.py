"""Geometry as column expressions: distances, boxes, rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings

#: Mean radius of the earth, km (fixed value).
EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance, null where a coordinate is; the haversine is held to [0, 1]."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    # least and greatest pass over nulls.
    return F.when(h.isNotNull(), F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def in_bbox(lon: Column, lat: Column, conf: Settings = DEFAULT) -> Column:
    """Inside the box, ends included; false where a coordinate is missing."""
    x0, y0, x1, y1 = conf.bbox
    return F.coalesce(lon.between(x0, x1) & lat.between(y0, y1), F.lit(False))


def fixed_coordinates(lon: Column, lat: Column, conf: Settings = DEFAULT) -> Column:
    """struct(lon, lat, missing, swapped, outside) after the record's own checks.

    Missing: null or exactly 0 on an axis.  Swapped: only the exchanged pair is in
    the box; it is exchanged.  Outside: in neither order; the pair becomes null.
    """
    missing = F.coalesce(lon.isNull() | lat.isNull() | (lon == 0) | (lat == 0), F.lit(True))
    swapped = ~missing & ~in_bbox(lon, lat, conf) & in_bbox(lat, lon, conf)
    x, y = F.when(swapped, lat).otherwise(lon), F.when(swapped, lon).otherwise(lat)
    outside = ~missing & ~in_bbox(x, y, conf)
    good = ~missing & ~outside
    return F.struct(
        F.when(good, x).alias("lon"), F.when(good, y).alias("lat"), missing.alias("missing"), swapped.alias("swapped"), outside.alias("outside")
    )


def _segments(ring: Column) -> Column:
    """The ring's sides as structs of two ends; the last side closes the ring."""
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.when(i + 1 == n, 0).otherwise(i + 1)).alias("b")),
    )


def inside_rings(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings (array of arrays of struct x, y): holes and several parts come out right."""
    sides = F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 3), _segments))
    crossed = F.filter(
        sides,
        lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y))
        & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def ring_distance(rings: Column, x: Column, y: Column) -> Column:
    """Planar distance, in the coordinates' unit, from a point to the nearest side."""

    def one(s):
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        along = ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        ex, ey = s["a"]["x"] + t * dx - x, s["a"]["y"] + t * dy - y
        return F.sqrt(ex * ex + ey * ey)

    return F.array_min(F.transform(F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 1), _segments)), one))


def covered_by(rings: Column, x: Column, y: Column, tolerance: float) -> Column:
    """Inside the rings or within ``tolerance`` of a side; sides count as inside."""
    return F.coalesce(inside_rings(rings, x, y) | (ring_distance(rings, x, y) <= tolerance), F.lit(False))


def encode_line(points: Column) -> Column:
    """"x,y;x,y" with six decimals from an array of struct(lon, lat)."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"])), ";")


def decode_line(text: Column) -> Column:
    """The array of struct(lon, lat) of "x,y;x,y"; empty parts are skipped."""
    parts = F.filter(F.split(text, ";"), lambda p: p != "")

    def point(p):
        xy = F.split(p, ",")
        return F.struct(F.get(xy, F.lit(0)).cast("double").alias("lon"), F.get(xy, F.lit(1)).cast("double").alias("lat"))

    return F.transform(parts, point)


def point_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f,%.5f", lat, lon)
