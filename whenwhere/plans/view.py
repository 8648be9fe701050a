"""A view's data: query events out of exported ones, first-wins places, and the filters in their order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, when
from ..functions.tags import strings
from ..operators import view as V


def parsed_occurrences(raw: Column) -> Column:
    """Local texts (start_date, start_time, end_date, end_time) as instants by start; ends default to starts, undated ones go."""

    def one(o):
        given = lambda t: F.when(o[t] != "", o[t])
        start = when.local_instant(when.strict_date(o["start_date"]), when.minutes_of(o["start_time"]))
        end = when.local_instant(when.strict_date(F.coalesce(given("end_date"), o["start_date"])), when.minutes_of(F.coalesce(given("end_time"), o["start_time"])))
        # without an end of its own, an occurrence ends when it starts
        same = given("end_date").isNull() & given("end_time").isNull()
        made = lambda s: F.struct(s.alias("start"), F.when(same, s).otherwise(F.coalesce(end, s)).alias("end"), o["start_time"].alias("start_time"), o["end_time"].alias("end_time"))
        return text.let(start, made)

    return F.array_sort(F.filter(F.transform(raw, one), lambda o: o["start"].isNotNull()))


def query_events(raw: DataFrame, places: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events of the application's range, ready for the filters: placed, missing texts blank, flag emoji replaced by the place's."""
    rows = raw.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn("occurrences", parsed_occurrences(F.col("occurrences")))
    rows = rows.where(when.any_overlap(F.col("occurrences"), start, end))
    at = places.select("lat", "lng", F.col("emoji").alias("_emoji"))
    rows = rows.join(at, ["lat", "lng"], "left")
    emoji = F.when(text.is_country_flag(F.col("emoji")), F.coalesce("_emoji", "emoji")).otherwise(F.col("emoji"))
    return rows.withColumns({"location": text.blank_if_missing(F.col("location")), "sublocation": text.blank_if_missing(F.col("sublocation")), "emoji": emoji, "location_key": F.concat_ws(",", "lat", "lng")}).drop("_emoji")


def first_places(locations: DataFrame, order: str) -> DataFrame:
    """One place for each pair of coordinates, the first in order."""
    rank = F.row_number().over(Window.partitionBy("lat", "lng").orderBy(order))
    return locations.withColumn("_r", rank).where("_r = 1").drop("_r")


def in_geotags(events: DataFrame, locations: DataFrame, geotags: tuple[str, ...]) -> DataFrame:
    """Events at places with one of the geotags, in any case."""
    near = locations.where(F.arrays_overlap(F.transform("tags", F.lower), strings([g.lower() for g in geotags])))
    return events.join(near.select("loc_id"), "loc_id", "left_semi")


def apply_filters(events: DataFrame, locations: DataFrame, states: V.TagStates, start: Column, end: Column, corners: list[tuple[float, float]] | None = None, geotags: tuple[str, ...] = ()) -> DataFrame:
    """Dates, then places' tags, then tags, then viewport."""
    rows = V.in_dates(events, start, end)
    if geotags:
        rows = in_geotags(rows, locations, geotags)
    rows = V.by_tags(rows, locations, states)
    return V.in_view(rows, locations, corners) if corners else rows


def by_location(events: DataFrame) -> DataFrame:
    """Events of each place in numbers; the lists are the rows themselves, partitioned by loc_id."""
    return events.groupBy("loc_id").agg(F.count("*").alias("n_events"), F.min("id").alias("first_id"))


def default_range(today: dt.date, first: dt.date, last: dt.date, days: int = 6) -> tuple[dt.date, dt.date]:
    """Today if it is in the application's range, else its first day; and the days that follow, up to its end."""
    start = today if first < today <= last else first
    return start, min(start + dt.timedelta(days=days), last)
