"""Distances on the sphere."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: IUGG mean Earth radius in metres.
EARTH_RADIUS_M = 6_371_008.8


def coordinate(value: Column) -> Column:
    """Text to double; NULL when it cannot be read."""
    return F.trim(value).try_cast("double")


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle metres; NULL when a coordinate is missing."""
    dphi = F.radians(lat_b) - F.radians(lat_a)
    dlam = F.radians(lon_b - lon_a)
    h = (F.pow(F.sin(dphi / 2), 2)
         + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlam / 2), 2))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))
