"""Many date windows asked at once: a join of ranges by day bins.

An interval stands in every bin of days that it touches, and two intervals that overlap share a bin; of the bins that they share the first settles
them, so each pair comes once. The join is on equal bins: no pair is looked at whose intervals are not within a bin's width of each other. An interval of
d days takes d / days + 1 rows; events are bounded by their longest duration, and wider bins suit longer windows.

Defined results: ends are part of intervals. An interval with a null end or one before its start overlaps nothing. Repeated rows are rows of their own.
Empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = 7


def _bin(moment: Column, days: int) -> Column:
    return F.floor(F.datediff(F.to_date(moment), F.lit("1970-01-01").cast("date")) / days)


def binned(rows: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Each interval in each of its bins; adds bin and first_bin."""
    fine = rows.where(F.col(start) <= F.col(end))
    first, last = _bin(F.col(start), days), _bin(F.col(end), days)
    return fine.withColumn("first_bin", first).withColumn("bin", F.explode(F.sequence("first_bin", last)))


def overlapping(events: DataFrame, windows: DataFrame, days: int = DAYS) -> DataFrame:
    """All pairs of events (start, end, ...) and windows (from, to, ...) that overlap, with the columns of both."""
    e = binned(events, "start", "end", days).withColumnRenamed("first_bin", "_e")
    w = binned(windows, "from", "to", days).withColumnRenamed("first_bin", "_w")
    met = e.join(w, "bin").where((F.col("bin") == F.greatest("_e", "_w")) & (F.col("start") <= F.col("to")) & (F.col("end") >= F.col("from")))
    return met.drop("bin", "_e", "_w")
