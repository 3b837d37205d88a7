"""Columns of points on the sphere, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance; null where any part is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() skips nulls, so a null is kept by hand
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def destination(lat: Column, lon: Column, degrees: Column, km: Column) -> tuple[Column, Column]:
    """(lat, lon) reached after ``km`` along a bearing; the longitude is wrapped to -180..180."""
    d, b, p = km / EARTH_KM, F.radians(degrees), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    side = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.degrees(to), F.pmod(lon + F.degrees(side) + 540, F.lit(360.0)) - 180


def approach(lat: Column, lon: Column, course: Column, speed_kmh: Column, minutes_ago: Column, to_lat: Column, to_lon: Column) -> tuple[Column, Column]:
    """(closest km, minutes from now to the closest point) of a path that began some minutes ago, seen from a reader, on a flat
    projection at the reader's latitude; null where that point has been passed."""
    dx = (to_lon - lon) * 111.32 * F.cos(F.radians(to_lat))
    dy = (to_lat - lat) * 110.57
    ahead = dx * F.sin(F.radians(course)) + dy * F.cos(F.radians(course))
    side = F.abs(dx * F.cos(F.radians(course)) - dy * F.sin(F.radians(course)))
    eta = ahead / speed_kmh * 60 - minutes_ago
    coming = (speed_kmh > 0) & (eta >= 0)
    return F.when(coming, side), F.when(coming, eta)
