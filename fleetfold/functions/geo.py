"""Great-circle geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius, metres.
EARTH_RADIUS_M = 6371008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + F.cos(a) * F.cos(b) * s_lon * s_lon
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial heading, degrees clockwise from north; 0 between equal points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    heading = F.pmod(F.atan2(y, x) * (180.0 / math.pi) + 360.0, F.lit(360.0))
    return F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(heading)


def wrap_offset(offset: Column, length: Column) -> Column:
    """Distance along a loop, brought into [0, length)."""
    return F.pmod(offset, length)


def lerp(start: Column, end: Column, at: Column, span: Column) -> Column:
    """Linear interpolation ``at`` metres into a segment of ``span`` metres, clamped to its ends."""
    t = F.when(span <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at / span)))
    return start + (end - start) * t


def kph_to_mps(kph: Column) -> Column:
    return kph / 3.6
