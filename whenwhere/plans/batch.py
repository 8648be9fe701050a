"""The batch side from tables of listings to the export, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import tags, text, when
from ..operators import listing as L
from ..sources import files
from ..sources.stages import staged

#: Box glyphs that are no use as an emoji.
BLOCKED_EMOJI = ["⬜", "□", "◻", "⬛", "■", "▪", "▫", "◼", "◾", "◽", "◿", "▢", "▣", "▤", "▥", "▦", "▧", "▨", "▩"]


class Counters:
    """How many rows pass each point of a run, counted within the stages' own jobs."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def at(self, name: str, df: DataFrame, **more: Column) -> DataFrame:
        """The same rows; once they are written, ``name`` says how many they were, and ``name.x`` how many of them had x."""
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(x) for x, c in more.items()))

    def totals(self) -> dict[str, int]:
        found = {}
        for name, seen in self._seen.items():
            got = seen.get
            found[name] = got.pop("rows")
            found |= {f"{name}.{x}": n for x, n in got.items()}
        return found


def listing_rows(pages: DataFrame, rules: tags.TagRules, as_of: Column, counters: Counters | None = None) -> DataFrame:
    """Rows of the pages' tables that are in reach, with their tags; pages have file, extra_tags and body."""
    pages = text.spread(pages)
    parsed = L.parse_tables(counters.at("pages", pages) if counters else pages)
    rows = (counters.at("parsed", parsed) if counters else parsed).where(when.within_reach(F.col("start_date"), F.col("end_date"), as_of))
    made = tags.with_virtual(tags.process(F.col("hashtags"), rules, F.col("extra_tags")), F.col("location"))
    rows = rows.withColumn("tags", made).where(tags.keeps(F.col("tags"), rules))
    return rows.where((F.coalesce("name", F.lit("")) != "") & ~text.is_cancelled(F.col("name"))).withColumn("name", text.recapitalise(F.col("name")))


def placed_rows(rows: DataFrame, locations: DataFrame, row_id: str, site: str | None = None) -> DataFrame:
    """Rows with lat, lng and an emoji that can be drawn, else the place's."""
    met = L.locate(rows, locations, row_id, site)
    own = text.first_emoji(F.col("emoji"))
    emoji = F.when(own.isNotNull() & ~own.isin(BLOCKED_EMOJI), own).otherwise(F.coalesce("place.emoji", "emoji"))
    return met.withColumns({"lat": F.col("place.lat"), "lng": F.col("place.lng"), "emoji": emoji}).drop("place")


def grouped_events(rows: DataFrame, file: str, order: str) -> DataFrame:
    """One event for each group of alike names of a file: shortest name, fields of the first row, distinct occurrences and urls in order."""
    keyed = rows.join(L.group_fuzzy(rows, file, order), [file, order])
    first = F.min_by(F.struct("description", "location", "sublocation", "emoji", "lat", "lng", "tags"), order).alias("f")
    name = F.min(F.struct(F.length("name").alias("n"), F.col(order).alias("at"), "name")).alias("best")
    links = F.array_sort(F.collect_list(F.struct(order, F.coalesce("url", F.lit("")).alias("url")))).alias("links")
    whens = F.array_sort(F.collect_list(F.struct(order, L.occurrence().alias("o")))).alias("whens")
    out = keyed.groupBy(file, "key_at").agg(name, first, links, whens)
    urls = F.array_distinct(F.filter(F.transform("links", lambda x: F.trim(x["url"])), lambda u: u != ""))
    return out.select(file, "key_at", F.col("best.name").alias("name"), text.short_name(F.col("best.name")).alias("short_name"), "f.*", urls.alias("urls"), F.array_distinct(F.transform("whens", lambda x: x["o"])).alias("occurrences"))


def in_order(events: DataFrame) -> DataFrame:
    """Adds pos: the files by name, then a file's events in order.

    Files are sorted by ranges and numbered within a range; the one window over all has a row a range.
    """
    ranged = staged(events.select("file").distinct().repartitionByRange("file").withColumn("_range", F.spark_partition_id()), "files")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("file")) + F.col("_before")
    files_ = ranged.join(starts, "_range").select("file", number.cast("long").alias("_n"))
    return events.join(files_, "file").withColumn("pos", F.shiftleft("_n", 32) + F.col("key_at")).drop("_n")


def exportable(events: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Named, placed events with an occurrence in the next ``days``."""
    near = F.exists("occurrences", lambda o: when.within_reach(o["start_date"], o["end_date"], as_of, ahead=days, longest=100_000))
    return events.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("name").isNotNull() & (F.size("occurrences") > 0) & near)


def merged(good: DataFrame) -> DataFrame:
    """Exportable events (pos, name, description, lat, lng, urls, occurrences), duplicates merged; adds first_start.

    The kept event gets the urls of all that were merged into it, in order, each once.
    """
    kept = L.dedup_fuzzy(good)
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "urls"))), lambda x: F.coalesce(x["urls"], F.array().cast("array<string>"))))
    urls = good.select("pos", "urls").join(kept, "pos").groupBy(F.col("kept_pos").alias("pos")).agg(F.array_distinct(F.filter(every, lambda u: F.coalesce(u, F.lit("")) != "")).alias("urls"))
    return good.drop("urls").join(urls, "pos").withColumn("first_start", when.strict_date(F.get("occurrences", F.lit(0))["start_date"]))


def export(events: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Exportable events, duplicates merged."""
    return merged(exportable(events, as_of, days))


def run_stages(stages: list[tuple[str, Callable[[], None]]]) -> list[str]:
    """Runs named stages in order and returns the names of those done; a failure stops the run and says where."""
    done: list[str] = []
    for name, stage in stages:
        try:
            stage()
        except Exception as e:
            raise RuntimeError(f"stage {name} failed after {', '.join(done) or 'none'}") from e
        done.append(name)
    return done


@dataclass(frozen=True)
class Run:
    """The stages that were done, and the rows at each point: pages, parsed, kept (and placed among them), events, exportable, exported."""

    stages: list[str]
    counts: dict[str, int]

    def report(self) -> dict[str, int]:
        """Rows read, dropped and merged by stage."""
        c = self.counts
        return {
            "pages read": c["pages"], "rows read": c["parsed"], "rows dropped": c["parsed"] - c["kept"], "rows without a place": c["placed"] - c["placed.found"],
            "rows merged into events": c["placed"] - c["events"], "events not exportable": c["events"] - c["exportable"], "events merged": c["exportable"] - c["exported"], "events exported": c["exported"],
        }


def run(pages: DataFrame, locations: DataFrame, rules: tags.TagRules, as_of: Column, root: str, site: str | None = None) -> Run:
    """Pages (file, extra_tags, body and, if named, a site) to the four parts of the export under ``root``."""
    held: dict[str, DataFrame] = {}
    counters = Counters()

    def process() -> None:
        rows = listing_rows(pages, rules, as_of, counters)
        held["rows"] = staged(counters.at("kept", rows.withColumn("row_id", F.xxhash64("file", "row_no"))), "rows")

    def place() -> None:
        rows = placed_rows(held["rows"], locations, "row_id", site)
        held["placed"] = staged(counters.at("placed", rows, found=F.col("lat").isNotNull()), "placed")

    def group() -> None:
        held["events"] = staged(counters.at("events", grouped_events(held["placed"], "file", "row_no")), "events")

    def write() -> None:
        good = staged(counters.at("exportable", exportable(in_order(held["events"]), as_of)), "exportable")
        events = staged(counters.at("exported", merged(good)), "export")
        files.write_export(L.split_export(events, locations, as_of), root)

    return Run(run_stages([("process", process), ("place", place), ("group", group), ("export", write)]), counters.totals())
