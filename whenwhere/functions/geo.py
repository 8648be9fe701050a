"""Places on the globe and scores by distance and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: The box of the first export.
INIT_BOX = (40.686695, -74.014855, 40.749285, -73.959385)


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return EARTH_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """Both sides included; box is (south, west, north, east)."""
    return lat.between(box[0], box[2]) & lng.between(box[1], box[3])


def in_quad(lat: Column, lng: Column, corners: list[tuple[float, float]]) -> Column:
    """Parity of the edges that a ray crosses; corners are (lat, lng) in order."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(corners, corners[-1:] + corners[:-1], strict=True):
        if y1 != y2:
            x = F.lit(x2 - x1) * (lat - y1) / F.lit(y2 - y1) + x1
            crossings = crossings + (((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lng < x)).cast("int")
    return crossings % 2 == 1


def proximity_bonus(distance: Column, most: float, reach: float) -> Column:
    return F.greatest(F.lit(0.0), most * (1 - distance / reach))


def edit_ratio(a: Column, b: Column) -> Column:
    """Shared length by edit distance: (|a| + |b| - d) / (|a| + |b|), 0 if either is empty."""
    total = F.length(a) + F.length(b)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), (total - F.levenshtein(a, b)) / total).otherwise(0.0)
