"""Scalar column expressions of the scores and the demand model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
METRES_PER_MILE = 1609.344
EARTH_RADIUS_M = 6371008.8  # mean radius of the great-circle distance


def pedscore(trips: Column, bwness: Column) -> Column:
    return F.log10(F.lit(1) + trips * bwness)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def stops_along(length: Column, spacing: float) -> Column:
    """0, spacing, 2 spacing, ... up to the length, and the length itself."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(length / spacing).cast("int")), lambda i: i * F.lit(float(spacing)))
    return F.array_distinct(F.array_append(steps, length))


def geoid(*parts: Column) -> Column:
    """State, county, tract and block-group codes joined into one key."""
    return F.concat(*parts)


def metres_to_miles(length: Column) -> Column:
    return length / METRES_PER_MILE
