"""Coordinates as column expressions."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the mean Earth radius in metres.
EARTH_RADIUS_M = 6_371_008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def local_xy(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin on a plane that touches there."""
    return F.radians(lon - lon0) * (EARTH_RADIUS_M * cos(radians(lat0))), F.radians(lat - lat0) * EARTH_RADIUS_M


def valid_coordinates(lon: Column, lat: Column) -> Column:
    ok = ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.coalesce(ok, F.lit(False))


def in_bbox(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def grown_extent(nodes: DataFrame, pad: float = 0.001) -> DataFrame:
    """One row (west, south, east, north): the nodes' extent, padded and kept on the globe."""
    return nodes.agg(
        F.greatest(F.min("lon") - pad, F.lit(-180.0)).alias("west"), F.greatest(F.min("lat") - pad, F.lit(-90.0)).alias("south"),
        F.least(F.max("lon") + pad, F.lit(180.0)).alias("east"), F.least(F.max("lat") + pad, F.lit(90.0)).alias("north"),
    )


def bbox_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    mid = F.radians((south + north) / 2)
    width = F.radians(east - west) * EARTH_RADIUS_M * F.cos(mid)
    return width * F.radians(north - south) * EARTH_RADIUS_M / 1e6


def utm_zone(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone of a point."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    return F.when(lat >= 0, F.lit(32600)).otherwise(32700) + zone


def fallback_elevation(lon: Column, lat: Column) -> Column:
    """A smooth stand-in where no elevation is known."""
    return F.lit(880.0) + F.lit(30.0) * F.sin(100 * lat) + F.lit(15.0) * F.cos(100 * lon)


def fallback_drain_distance(lon: Column, lat: Column, meridian: float, most: float) -> Column:
    """East-west metres to a fixed meridian, cut at `most`."""
    d = F.abs(F.radians(lon - meridian)) * EARTH_RADIUS_M * F.cos(F.radians(lat))
    return F.least(d, F.lit(float(most)))


def grade(from_elev: Column, to_elev: Column, length: Column, most: float) -> Column:
    return F.least(F.greatest((to_elev - from_elev) / length, F.lit(-float(most))), F.lit(float(most)))


def ring_area(ring: Column) -> Column:
    """The area of a closed ring of (x, y) structs, by the shoelace sum."""
    n = F.size(ring)
    cross = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["y"]
        - F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["x"] * F.element_at(ring, i)["y"],
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2
