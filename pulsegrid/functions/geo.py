"""Geography as column expressions: distance, boxes and polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in metres.
EARTH_METERS = 6_371_008.8
METERS_A_DEGREE = 111_194.9


def haversine_meters(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null where a coordinate is null."""
    up, across = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(up) * F.sin(up) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(across) * F.sin(across)
    return F.lit(2 * EARTH_METERS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_ring(ring: Column, lat: Column, lng: Column) -> Column:
    """Ray cast against a ring of ``array<struct<lat, lng>>``, closed or not."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lng"]
        return F.coalesce(spans & (lng < at), F.lit(False))

    hits = F.filter(F.zip_with(ring, after, crosses), lambda x: x)
    return F.size(hits) % 2 == 1


def in_polygon(rings: Column, lat: Column, lng: Column) -> Column:
    """Inside the first ring and outside the others."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(F.get(rings, F.lit(0)), lat, lng) & ~F.exists(holes, lambda r: in_ring(r, lat, lng))


def box_of(rings: Column) -> Column:
    """``struct<south, north, west, east>`` of the outer ring."""
    outer = F.get(rings, F.lit(0))
    lats, lngs = F.transform(outer, lambda p: p["lat"]), F.transform(outer, lambda p: p["lng"])
    return F.struct(F.array_min(lats).alias("south"), F.array_max(lats).alias("north"), F.array_min(lngs).alias("west"), F.array_max(lngs).alias("east"))


def in_geometry(polygons: Column, lat: Column, lng: Column) -> Column:
    """Inside any polygon of an array of polygons."""
    return F.exists(polygons, lambda rings: in_polygon(rings, lat, lng))


def box_of_geometry(polygons: Column) -> Column:
    """``struct<south, north, west, east>`` of all outer rings of an array of polygons."""
    points = F.flatten(F.transform(polygons, lambda rings: F.get(rings, F.lit(0))))
    return box_of(F.array(points))


def near_box(lat: Column, lng: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Whether a point lies in the box of two corners (lat, lng), edges included; null for no point."""
    return lat.between(low[0], high[0]) & lng.between(low[1], high[1])
