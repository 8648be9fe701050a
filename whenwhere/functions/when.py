"""Dates, times of day and occurrences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ZONE = "America/New_York"
MAX_DAYS, AHEAD_DAYS = 400, 90


def strict_date(text: Column) -> Column:
    """A date written Y-M-D, padded or not; null otherwise."""
    # a cast would take other forms too, and a year 0
    return F.when(text.rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\z"), text.try_cast("date"))


def standard_time(text: Column) -> Column:
    """6:30 PM and 6:30 p.m. as 6:30pm, 7:00pm as 7pm, all day as empty."""
    out = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit("")), F.lit("."), F.lit(""))
    return F.when(out == "allday", "").otherwise(F.replace(out, F.lit(":00"), F.lit("")))


def minutes_of(text: Column) -> Column:
    """Minutes after midnight; what is no time of day is noon."""
    form = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$"

    def of(low: Column) -> Column:
        # the nought stands for a number that is missing; a cast that fails costs an exception a row
        hour, minute = (F.concat(F.lit("0"), F.regexp_extract(low, form, n)).cast("int") for n in (1, 2))
        half = lambda h, to: F.when(F.contains(low, F.lit("pm")) & (h < 12), h + 12).when(F.contains(low, F.lit("am")) & (h == 12), 0).otherwise(h) * 60 + to
        return F.when(low.rlike(form), let(hour, lambda h: half(h, minute))).otherwise(720)

    return let(F.lower(F.trim(F.coalesce(text, F.lit("")))), of)


def local_instant(day: Column, minutes: Column, zone: str = ZONE) -> Column:
    """The instant of a wall time, with the offset that holds at noon of the day."""

    def at(day: Column) -> Column:
        noon = (day.cast("timestamp_ntz") + F.expr("interval 12 hours")).cast("timestamp")
        shift = let(noon, lambda n: F.unix_micros(F.to_utc_timestamp(n, zone)) - F.unix_micros(n))
        wall = F.unix_micros(day.cast("timestamp_ntz").cast("timestamp")) + minutes.cast("long") * 60_000_000
        return F.timestamp_micros(wall + shift)

    return let(day, at)


def within_reach(start: Column, end: Column, as_of: Column, ahead: int = AHEAD_DAYS, longest: int = MAX_DAYS) -> Column:
    """Whether text dates are valid, not over, not too far ahead and not too long."""
    reach = lambda first, last: (first <= F.date_add(as_of, ahead)) & (last >= as_of) & (F.datediff(last, first) <= longest)
    until = lambda first: F.when(F.trim(F.coalesce(end, F.lit(""))) != "", strict_date(F.trim(end))).otherwise(first)
    return F.coalesce(let(strict_date(F.trim(start)), lambda first: let(until(first), lambda last: reach(first, last))), F.lit(False))


def overlapping(occurrences: Column, start: Column, end: Column) -> Column:
    """The occurrences that overlap [start, end]."""
    return F.filter(occurrences, lambda o: (o["start"] <= end) & (o["end"] >= start))


def any_overlap(occurrences: Column, start: Column, end: Column) -> Column:
    return F.exists(occurrences, lambda o: (o["start"] <= end) & (o["end"] >= start))


def clock(moment: Column) -> Column:
    """7pm, 6:30am."""
    return F.replace(F.lower(F.replace(F.date_format(moment, "h:mm a"), F.lit(" "), F.lit(""))), F.lit(":00"), F.lit(""))


def one_occurrence(o: Column) -> Column:
    """Jul 4, 7pm–9pm; Jul 4, 7pm – Jul 6. o has start, end, start_time, end_time (texts; blank for none)."""
    from_, to = (F.when(F.trim(F.coalesce(o[t], F.lit(""))) != "", clock(o[m])).otherwise("") for m, t in (("start", "start_time"), ("end", "end_time")))
    first, last = F.date_format(o["start"], "MMM d"), F.date_format(o["end"], "MMM d")
    lead = F.when(from_ != "", F.concat(first, F.lit(", "), from_)).otherwise(first)
    one_day = F.when((from_ != "") & (to != "") & (from_ != to), F.concat(lead, F.lit("–"), to)).otherwise(lead)
    tail = F.when(to != "", F.concat(F.lit(", "), to)).otherwise("")
    return F.when(F.to_date(o["start"]) == F.to_date(o["end"]), one_day).otherwise(F.concat(lead, F.lit(" – "), last, tail))


def many_occurrences(occurrences: Column) -> Column:
    """Jul 4: 7pm, 9pm; Jul 5 — days and times in order, each once."""
    day = lambda o: F.to_date(o["start"])

    def time(o):
        from_, to = (F.when(F.trim(F.coalesce(o[t], F.lit(""))) != "", clock(o[m])).otherwise("") for m, t in (("start", "start_time"), ("end", "end_time")))
        same = F.to_date(o["start"]) == F.to_date(o["end"])
        return F.when((from_ != "") & (to != "") & same & (from_ != to), F.concat(from_, F.lit("–"), to)).otherwise(from_)

    def told(d):
        times = F.array_distinct(F.filter(F.transform(F.filter(occurrences, lambda o: day(o) == d), time), lambda t: t != ""))
        return F.when(F.size(times) > 0, F.concat(F.date_format(d, "MMM d"), F.lit(": "), F.array_join(times, ", "))).otherwise(F.date_format(d, "MMM d"))

    return F.array_join(F.transform(F.array_distinct(F.transform(occurrences, day)), told), "; ")


def compact(occurrences: Column) -> Column:
    """The dates and times of an event in short."""
    return F.when(F.coalesce(F.size(occurrences), F.lit(0)) <= 0, "Date/Time N/A").when(F.size(occurrences) == 1, one_occurrence(F.get(occurrences, 0))).otherwise(many_occurrences(occurrences))


def display_day(moment: Column) -> Column:
    """Jan 5, 2024; null stays null."""
    return F.date_format(moment, "MMM d, yyyy")


def url_day(moment: Column) -> Column:
    """2024-01-05."""
    return F.date_format(moment, "yyyy-MM-dd")
