"""Places clustered by Z-order cells, so that a view or a circle reads only the parts of the table that may hold its places.

A cell is a pair of 26-bit degrees with interleaved bits; places near each other mostly have cells near each other. The table lies sorted by cell. A region is
covered by at most ``MOST_RANGES`` ranges of cells (quadrants that lie within it or across its edge), which reach the scan as filters, and
the exact test follows. The cover is found from the region alone, whatever the table's size.

Defined results: degrees off the globe fall in the cells at its edge, as regions do, so none is lost. Places with a null coordinate are in no region and
are not written. Repeated rows are rows of their own; any number of places may share a cell and still be written by several tasks.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import view

BITS = 26
MOST_RANGES = 32
Box = tuple[float, float, float, float]


def _step(degrees: float, reach: float) -> int:
    """Where a degree lies on its axis, in units of 2^-26 of it."""
    return min(max(math.floor((degrees + reach) / (2 * reach) * (1 << BITS)), 0), (1 << BITS) - 1)


def _steps(degrees: Column, reach: float) -> Column:
    # a double up to 2^26 is exact enough to be compared before it is a long, so no degree overflows
    share = (degrees + reach) / (2 * reach) * float(1 << BITS)
    return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(float((1 << BITS) - 1))))


def _spread(x: Column) -> Column:
    """A zero between any two bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def cell(lat: Column, lng: Column) -> Column:
    return F.shiftleft(_spread(_steps(lat, 90.0)), 1).bitwiseOR(_spread(_steps(lng, 180.0)))


def ranges(box: Box, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of cells, ends included, that together hold all of a box (south, west, north, east); the largest quadrants are split first."""
    south, west, north, east = _step(box[0], 90.0), _step(box[1], 180.0), _step(box[2], 90.0), _step(box[3], 180.0)
    if box[0] > box[2] or box[1] > box[3]:
        return []
    whole: list[tuple[int, int]] = []
    open_ = [(-BITS, 0, 0, 0)]  # negative level, first cell, lat and lng of the corner
    while open_ and len(whole) + len(open_) + 3 <= most:
        level, first, y, x = heapq.heappop(open_)
        half = 1 << -level - 1
        for q, (dy, dx) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            at, b, a = first + q * half * half, y + dy * half, x + dx * half
            if b > north or b + half - 1 < south or a > east or a + half - 1 < west:
                continue
            if half == 1 or (b >= south and b + half - 1 <= north and a >= west and a + half - 1 <= east):
                whole.append((at, at + half * half - 1))
            else:
                heapq.heappush(open_, (level + 1, at, b, a))
    found: list[tuple[int, int]] = []
    for a, b in sorted(whole + [(first, first + 4**-level - 1) for level, first, _, _ in open_]):
        if found and found[-1][1] + 1 == a:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


def circle_boxes(lat: float, lng: float, metres: float) -> list[Box]:
    """Boxes that hold all within ``metres``: one, two across the 180th meridian, all longitudes where a pole is near."""
    angle = metres / geo.EARTH_M * (1 + 1e-9) + 1e-12
    south, north = lat - math.degrees(angle), lat + math.degrees(angle)
    if south <= -90 or north >= 90:
        return [(south, -180.0, north, 180.0)]
    reach = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + 1e-9
    west, east = lng - reach, lng + reach
    if west < -180:
        return [(south, -180.0, north, east), (south, west + 360, north, 180.0)]
    if east > 180:
        return [(south, west, north, 180.0), (south, -180.0, north, east - 360)]
    return [(south, west, north, east)]


@dataclass(frozen=True)
class PlaceTable:
    """Places (lat, lng, ...) that ``write`` has clustered."""

    spark: SparkSession
    path: str

    @property
    def places(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def in_boxes(self, boxes: list[Box]) -> DataFrame:
        """Places of the cells that the boxes touch: all that are in a box, and some beside it."""
        hit = F.lit(False)
        for box in boxes:
            for a, b in ranges(box, max(MOST_RANGES // len(boxes), 4)):
                hit = hit | F.col("cell").between(a, b)
        return self.places.where(hit).drop("cell")

    def in_view(self, corners: list[tuple[float, float]]) -> DataFrame:
        """Places within a quadrilateral of corners (lat, lng)."""
        (south, west), (north, east) = view.envelope(corners)
        return self.in_boxes([(south, west, north, east)]).where(geo.in_quad(F.col("lat"), F.col("lng"), corners))

    def near(self, lat: float, lng: float, metres: float) -> DataFrame:
        """Places at most ``metres`` away, with their distance."""
        return view.distances(self.in_boxes(circle_boxes(lat, lng, metres)), lat, lng).where(F.col("distance") <= metres)


def write(places: DataFrame, path: str, key: str = "loc_id") -> PlaceTable:
    """Writes places sorted by cell under a folder that does not exist; those of one cell are spread by their key."""
    rows = places.where("lat is not null and lng is not null").withColumn("cell", cell(F.col("lat"), F.col("lng")))
    rows.repartitionByRange("cell", key).sortWithinPartitions("cell").write.option("parquet.block.size", 16 << 20).parquet(path)
    return PlaceTable(places.sparkSession, path)
