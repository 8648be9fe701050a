"""View state in addresses: validated parameters, and the address of a state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .when import strict_date

MAX_TAGS, MAX_TAG, MAX_VALUE = 50, 100, 1000


def parameter(url: Column, name: str) -> Column:
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(found != "", F.try_url_decode(found))


def number(text: Column, low: float, high: float) -> Column:
    """A leading number in range; what follows it is ignored."""
    value = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.when((F.length(text) <= MAX_VALUE) & value.between(low, high), value)


def day(text: Column) -> Column:
    value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), strict_date(text))
    return F.when(F.year(value).between(2000, 2100), value)


def tag_list(text: Column) -> Column:
    parts = F.slice(F.transform(F.split(F.coalesce(text, F.lit("")), ","), F.trim), 1, MAX_TAGS)
    return F.filter(parts, lambda t: (F.length(t) <= MAX_TAG) & t.rlike(r"^[a-zA-Z0-9\s\-_&]+$"))


def view_state(url: Column) -> dict[str, Column]:
    """lat, lng, zoom, start, end, tags of an address; null or empty where missing or invalid."""
    zoom = F.regexp_extract(parameter(url, "zoom"), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return {
        "lat": number(parameter(url, "lat"), -90, 90),
        "lng": number(parameter(url, "lng"), -180, 180),
        "zoom": F.when(zoom.between(1, 20), zoom),
        "start": day(parameter(url, "start")),
        "end": day(parameter(url, "end")),
        "tags": tag_list(parameter(url, "tags")),
    }


def share_url(base: str, lat: Column, lng: Column, zoom: Column, start: Column, end: Column, tags: Column) -> Column:
    """Coordinates to five decimals; dates only together; tags joined by commas."""
    dates = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("&start="), start.cast("string"), F.lit("&end="), end.cast("string")))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("&tags="), F.url_encode(F.array_join(tags, ","))))
    return F.concat(F.lit(f"{base}?lat="), F.format_string("%.5f", lat), F.lit("&lng="), F.format_string("%.5f", lng), F.lit("&zoom="), zoom.cast("string"), F.coalesce(dates, F.lit("")), F.coalesce(listed, F.lit("")))
