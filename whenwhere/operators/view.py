"""The interactive side: date, tag and viewport filters, facets, and ranked search over events, places and tags.

Events have id, loc_id, name, tags, occurrences (array of start, end; by start); locations have loc_id, name, short_name,
tags, lat, lng. All operators are plans over these; only the search index (search_index.py) is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text, when
from ..functions.tags import strings


@dataclass(frozen=True)
class TagStates:
    """Tags by state; implicit ones come with selected ones (related tags)."""

    selected: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    implicit: tuple[str, ...] = ()


@dataclass(frozen=True)
class Weights:
    """Fixed values of the scores."""

    matching: float = 10.0
    multi_tag: float = 3.0
    visible: float = 5.0
    proximity: float = 5.0
    reach_m: float = 20_000.0
    temporal: float = 5.0
    reach_days: float = 30.0
    exact: float = 1000.0
    tag: float = 5.0
    frequency: float = 0.01


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def all_tags(own: Column, place: Column) -> Column:
    return F.array_union(F.coalesce(own, strings([])), F.coalesce(place, strings([])))


def in_dates(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events with an occurrence in [start, end]; adds those as matching_occurrences."""
    return events.withColumn("matching_occurrences", when.overlapping(F.col("occurrences"), start, end)).where(F.size("matching_occurrences") > 0)


def on_dates(events: DataFrame, occurrences: DataFrame, start: Column, end: Column) -> DataFrame:
    """The same over occurrences as rows (id, start, end): the dates reach the scan, and only what overlaps is gathered by event."""
    hit = occurrences.where((F.col("start") <= end) & (F.col("end") >= start))
    return events.join(hit.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("matching_occurrences")), "id")


def matches(tags: Column, states: TagStates) -> Column:
    """None forbidden, all required, and any selected or implicit unless none is selected or some are required."""
    any_of = states.selected + states.implicit
    out = F.lit(True)
    if states.forbidden:
        out = out & ~F.arrays_overlap(tags, strings(states.forbidden))
    if states.required:
        return out & (F.size(F.array_except(strings(states.required), tags)) == 0)
    return out & F.arrays_overlap(tags, strings(any_of)) if any_of else out


def by_tags(events: DataFrame, locations: DataFrame, states: TagStates, enriched: tuple[str, ...] | None = None) -> DataFrame:
    """The list's filter: required tags (all) go before selected ones (any), both over own and place tags; forbidden looks at own tags only."""
    selected = states.selected + states.implicit if enriched is None else enriched
    if not selected and not states.required:
        return events
    met = events.join(locations.select("loc_id", F.col("tags").alias("_place")), "loc_id", "left")
    both = all_tags(F.col("tags"), F.col("_place"))
    hit = F.size(F.array_except(strings(states.required), both)) == 0 if states.required else F.arrays_overlap(both, strings(selected))
    if states.forbidden:
        hit = hit & ~F.arrays_overlap(F.coalesce("tags", strings([])), strings(states.forbidden))
    return met.where(hit).drop("_place")


def in_view(events: DataFrame, locations: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    places = locations.where(geo.in_quad(F.col("lat"), F.col("lng"), corners)).select("loc_id")
    return events.join(places, "loc_id", "left_semi")


def distances(locations: DataFrame, lat: float, lng: float) -> DataFrame:
    return locations.withColumn("distance", geo.distance_m(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng)))


def tag_places(events: DataFrame, locations: DataFrame) -> DataFrame:
    """(tag, loc_id, id): the inverted index of events by own and place tags."""
    met = events.join(locations.select("loc_id", F.col("tags").alias("_place")), "loc_id", "left")
    return met.select("loc_id", "id", F.explode(F.array_distinct(all_tags(F.col("tags"), F.col("_place")))).alias("tag"))


def tag_index(events: DataFrame, locations: DataFrame) -> DataFrame:
    """n_events, first_id and last_id of each tag's posting list; the lists themselves are the rows of ``tag_places``."""
    return tag_places(events, locations).groupBy("tag").agg(F.count("*").alias("n_events"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def tag_frequency(events: DataFrame, locations: DataFrame) -> DataFrame:
    """Distinct places of each tag, over events and places."""
    pairs = events.select("loc_id", F.explode("tags").alias("tag")).unionByName(locations.select("loc_id", F.explode("tags").alias("tag")))
    return pairs.groupBy("tag").agg(F.countDistinct("loc_id").alias("frequency"))


def vocabulary(events: DataFrame, locations: DataFrame) -> DataFrame:
    return events.select(F.explode("tags").alias("tag")).unionByName(locations.select(F.explode("tags").alias("tag"))).distinct()


def dynamic_frequency(matching: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct places of each tag over matching events, zero for the rest of the vocabulary."""
    found = matching.select("loc_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("loc_id").alias("n"))
    return words.join(found, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("frequency"))


def visible_facets(visible: DataFrame, measured: DataFrame) -> DataFrame:
    """Per tag of visible events the sum of 1 and a weight that falls with distance."""
    near = F.greatest(F.lit(0.0), 1 - F.col("distance") / 20000.0)
    return visible.join(measured.select("loc_id", "distance"), "loc_id").select(F.explode("tags").alias("tag"), (1 + near).alias("w")).groupBy("tag").agg(F.sum("w").alias("weight"))


def tag_score(tags: Column, chosen: dict[str, float], w: Weights) -> Column:
    """Sum of the weights of the chosen tags among ``tags``; 0 unless two are chosen."""
    if len(chosen) < 2:
        return F.lit(0.0)
    total = F.lit(0.0)
    for tag, weight in chosen.items():
        total = total + F.when(F.array_contains(tags, tag), weight * w.multi_tag).otherwise(0.0)
    return total


def temporal_bonus(occurrences: Column, at: Column, w: Weights) -> Column:
    """Full while an event is on (less up to five days of its age), falling to 0 over the reach in days."""
    day = 86_400_000_000.0
    first = F.get(occurrences, 0)
    ahead = (micros(first["start"]) - micros(at)) / day
    on = (first["start"] <= at) & (first["end"] >= at)
    gap = F.when(on, F.greatest(F.lit(0.0), F.abs(ahead) - 5.0)).otherwise(F.abs(ahead))
    return F.when(F.size(occurrences) > 0, F.greatest(F.lit(0.0), w.temporal * (1 - gap / w.reach_days))).otherwise(0.0)


def searchable(rows: DataFrame, *fields: str) -> Column:
    """The text in which a term is looked for: the search forms of the fields that are there and not empty; arrays of tags give all theirs."""
    there = [f for f in fields if f in rows.columns]
    parts = F.concat(*(F.coalesce(F.col(f), strings([])) if rows.schema[f].dataType.typeName() == "array" else F.array(F.col(f)) for f in there))
    return text.search_form(F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " "))


EVENT_FIELDS, PLACE_FIELDS = ("name", "short_name", "description", "location", "sublocation"), ("name", "short_name", "tags")


def searchable_entries(events: DataFrame, locations: DataFrame, words: DataFrame) -> DataFrame:
    """(type, ref, text) of all that can be searched; ``search_index.write`` makes an index of it."""
    one = lambda rows, kind, ref, *fields: rows.select(F.lit(kind).alias("type"), F.col(ref).cast("string").alias("ref"), searchable(rows, *fields).alias("text"))
    return one(events, "event", "id", *EVENT_FIELDS).unionByName(one(locations, "location", "loc_id", *PLACE_FIELDS)).unionByName(one(words, "tag", "tag", "tag"))


def _wanted(rows: DataFrame, term: str | None, found: DataFrame | None, kind: str, ref: str) -> DataFrame:
    """All rows without a term at all; with an empty one those that match or are seen; else those that the index found."""
    if not term:
        return rows if term is None else rows.where("is_matching or is_visible")
    if found is None:
        raise ValueError("a search with a term needs what SearchIndex.find gave for it")
    return rows.join(found.where(F.col("type") == kind).select(F.col("ref").alias("_ref")), F.col(ref).cast("string") == F.col("_ref"), "left_semi")


def search_locations(measured: DataFrame, matching: DataFrame, visible: DataFrame, chosen: dict[str, float], w: Weights, term: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """Adds is_matching, is_visible and score to places with a distance; matching and visible are sets of loc_id; ``found`` is what the index has for the term."""
    m = matching.select("loc_id").distinct().withColumn("_m", F.lit(1))
    v = visible.select("loc_id").distinct().withColumn("_v", F.lit(1))
    rows = measured.join(m, "loc_id", "left").join(v, "loc_id", "left").withColumn("is_matching", F.col("_m").isNotNull()).withColumn("is_visible", F.col("_v").isNotNull())
    score = 1 + w.matching * F.col("is_matching").cast("int") + tag_score(F.col("tags"), chosen, w) + geo.proximity_bonus(F.coalesce("distance", F.lit(0.0)), w.proximity, w.reach_m) + w.visible * F.col("is_visible").cast("int")
    return _wanted(rows.drop("_m", "_v"), term, found, "location", "loc_id").withColumn("score", score)


def search_events(events: DataFrame, measured: DataFrame, matching: DataFrame, visible: DataFrame, chosen: dict[str, float], at: Column, w: Weights, term: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """Adds is_matching, is_visible and score to events; matching is a set of id, visible one of loc_id."""
    m = matching.select("id").distinct().withColumn("_m", F.lit(1))
    v = visible.select("loc_id").distinct().withColumn("_v", F.lit(1))
    place = measured.select("loc_id", F.col("tags").alias("_place"), "distance")
    # the bonus before the joins: where no one asks for them, occurrences are not shuffled
    rows = events.withColumn("_bonus", temporal_bonus(F.col("occurrences"), at, w)).join(place, "loc_id", "left").join(v, "loc_id", "left").join(m, "id", "left")
    rows = rows.withColumn("is_matching", F.col("_m").isNotNull()).withColumn("is_visible", F.col("_v").isNotNull())
    score = (
        1
        + w.matching * F.col("is_matching").cast("int")
        + tag_score(all_tags(F.col("tags"), F.col("_place")), chosen, w)
        + geo.proximity_bonus(F.coalesce("distance", F.lit(0.0)), w.proximity, w.reach_m)
        + F.col("_bonus")
        + w.visible * F.col("is_visible").cast("int")
    )
    return _wanted(rows.drop("_m", "_v"), term, found, "event", "id").withColumn("score", score).drop("_place", "_bonus")


def search_tags(words: DataFrame, dynamic: DataFrame, visible: DataFrame, frequency: DataFrame, term: str, w: Weights, geotags: tuple[str, ...] = (), found: DataFrame | None = None) -> DataFrame:
    """Scores of tags by the counts of matching, visible and all events; geotags (lower case) are shown only with a term."""
    if not term:
        words = (words.where(~F.lower("tag").isin(*geotags)) if geotags else words).withColumn("_whole", F.lit(False))
    elif found is None:
        raise ValueError("a search with a term needs what SearchIndex.find gave for it")
    else:
        words = words.join(found.where("type = 'tag'").select(F.col("ref").alias("tag"), F.col("is_whole").alias("_whole")).distinct(), "tag")
    rows = words.join(dynamic.withColumnRenamed("frequency", "_d"), "tag", "left").join(visible.withColumnRenamed("weight", "_v"), "tag", "left").join(frequency.withColumnRenamed("frequency", "_f"), "tag", "left")
    score = F.coalesce("_d", F.lit(0)) + w.exact * F.col("_whole").cast("int") + F.when(F.col("_v").isNotNull(), w.tag * F.col("_v") + w.visible).otherwise(0.0) + w.frequency * F.coalesce("_f", F.lit(0))
    return rows.select("tag", F.col("_v").isNotNull().alias("is_visible"), score.alias("score"))


def perform_search(events: DataFrame, measured: DataFrame, matching: DataFrame, visible: DataFrame, tags: DataFrame, chosen: dict[str, float], at: Column, w: Weights, term: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """(type, ref, is_visible, score) of places, events and tags; ``tags`` is what search_tags gave for the same term, ``found`` what the index did."""
    one = lambda rows, kind, ref: rows.select(F.lit(kind).alias("type"), F.col(ref).cast("string").alias("ref"), "is_visible", "score")
    places = search_locations(measured, matching, visible, chosen, w, term, found)
    events = search_events(events, measured, matching, visible, chosen, at, w, term, found)
    return one(places, "location", "loc_id").unionByName(one(events, "event", "id")).unionByName(one(tags, "tag", "tag"))


def grouped_top(results: DataFrame, k: int = 100, term: str = "", selected: str | None = None, states: TagStates | None = None) -> DataFrame:
    """The k best results of each type, visible and hidden ones apart; hidden ones only without a term.

    The selected place leads the visible places; tags that are selected, required or forbidden are no results.
    """
    rows = results.withColumn("hidden", ~F.col("is_visible") & F.lit(term.strip() == ""))
    if states and (set_ := states.selected + states.required + states.forbidden):
        rows = rows.where((F.col("type") != "tag") | ~F.col("ref").isin(*set_))
    ahead = (F.col("type") == "location") & ~F.col("hidden") & (F.col("ref") == F.lit(selected)) if selected is not None else F.lit(False)
    rows = rows.withColumn("_ahead", ahead)
    rank = F.row_number().over(Window.partitionBy("type", "hidden").orderBy(F.desc("_ahead"), F.desc("score"), "ref"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("_ahead")


def section_order(dismissed: DataFrame, key: str, section: str, at: str, sections: tuple[str, ...]) -> DataFrame:
    """(key, sections): each viewer's sections as they stand after all that was dismissed: a dismissed one goes to the end.

    That is the sections never dismissed, as given, then the others by their last dismissal; equal times keep the given order. Other sections,
    null ones and null times count for nothing.
    """

    def dismissed_at(s: str) -> Column:
        return F.get(F.filter("_last", lambda x: x["s"] == s), F.lit(0))["_at"]

    last = dismissed.groupBy(key, section).agg(F.max(at).alias("_at"))
    mine = last.groupBy(key).agg(F.collect_list(F.when(F.col(section).isin(*sections) & F.col("_at").isNotNull(), F.struct(F.col(section).alias("s"), "_at"))).alias("_last"))
    ranked = F.array(*(F.struct(dismissed_at(s).alias("at"), F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in enumerate(sections)))
    return mine.select(key, F.transform(F.array_sort(ranked), lambda x: x["s"]).alias("sections"))


def with_forced(shown: DataFrame, events: DataFrame, forced: int | None) -> DataFrame:
    """The events shown at their places, and the forced one if it is not among them."""
    if forced is None:
        return shown
    return shown.unionByName(events.where(F.col("id") == forced).join(shown.select("id"), "id", "left_anti"), allowMissingColumns=True)


def links(events: DataFrame, key: str, urls: str) -> DataFrame:
    """(key, position, url): an event's web addresses, the first of each host; those whose host cannot be read all stay."""
    rows = events.select(key, F.posexplode(urls).alias("position", "url")).where(text.is_web_url(F.col("url")))
    host = text.host_of(F.col("url"))
    rank = F.row_number().over(Window.partitionBy(key, host).orderBy("position"))
    return rows.withColumn("_r", rank).where((F.col("_r") == 1) | (host == "")).drop("_r")


def header_tags(locations: DataFrame, geotags: tuple[str, ...]) -> DataFrame:
    """Places with the tags that their header shows: all but geotags."""
    return locations.withColumn("tags", F.filter("tags", lambda t: ~F.array_contains(strings(geotags), F.lower(t))))


def with_matches(locations: DataFrame, matching: DataFrame) -> DataFrame:
    """Places where an event matches."""
    return locations.join(matching.select("loc_id"), "loc_id", "left_semi")


def select_tags(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, tag): each wanted tag as the vocabulary spells it, exactly or else in any case (the first in order)."""
    exact = wanted.join(words, wanted["wanted"] == words["tag"], "left_semi").select("wanted", F.col("wanted").alias("tag"))
    folded = words.groupBy(F.lower("tag").alias("_low")).agg(F.min("tag").alias("tag"))
    rest = wanted.join(exact.select("wanted"), "wanted", "left_anti").withColumn("_low", F.lower("wanted"))
    return exact.unionByName(rest.join(folded, "_low").select("wanted", "tag"))


def first_markers(locations: DataFrame, limit: int = 1000) -> DataFrame:
    """The places that get a marker, numbered in the order of their coordinates; (0, 0) is no place."""
    at = locations.where("lat <> 0 or lng <> 0")
    # the limit is the feature; it comes before the numbering, so the one window has no more rows
    return at.orderBy("lat", "lng", "loc_id").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("lat", "lng", "loc_id")))


def marker_colour(emoji: Column, colours: dict[str, str], other: str = "#444") -> Column:
    if not colours:
        return F.lit(other)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in colours.items() for x in pair)), emoji), F.lit(other))


def envelope(corners: list[tuple[float, float]]) -> tuple[tuple[float, float], tuple[float, float]]:
    """South-west and north-east corner of what a view shows."""
    lats, lngs = zip(*corners, strict=True)
    return (min(lats), min(lngs)), (max(lats), max(lngs))


def last_by_id(events: DataFrame, order: str) -> DataFrame:
    """One event for each id, the last in order."""
    return events.groupBy("id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "id"]), order).alias("e")).select("id", "e.*")


def popup_rank(events: DataFrame, selected: tuple[str, ...], at: Column, forced: int | None = None) -> DataFrame:
    """Order of the events of a place: forced one, matching ones, selected tags, nearness in time; and whether each is open."""
    chosen = F.size(F.array_intersect("tags", strings(selected)))
    gap = F.aggregate("occurrences", F.lit(9.2e18), lambda s, o: F.least(s, F.when((o["start"] <= at) & (o["end"] >= at), 0.0).otherwise(F.abs(micros(o["start"]) - micros(at)).cast("double"))))
    first = F.lit(False) if forced is None else F.col("id") == forced
    w = Window.partitionBy("loc_id").orderBy(F.desc("forced"), F.desc("is_matching"), F.desc("chosen"), "gap", "id")
    rows = events.withColumns({"forced": first, "chosen": chosen, "gap": gap})
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("n_here", F.count("*").over(Window.partitionBy("loc_id")))
    return rows.withColumn("is_open", F.col("forced") | F.col("is_matching") | (F.col("n_here") < 4) | (F.col("place") == 1))


def related(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tag, weight): chosen tags at 1 and their neighbours at the greatest weight; a chosen tag stays at 1, weights over 1 count for nothing."""
    near = edges.join(chosen, "tag").groupBy(F.col("related").alias("tag")).agg(F.max("weight").alias("weight")).where("weight < 1")
    return chosen.select("tag", F.lit(1.0).alias("weight")).unionByName(near.join(chosen, "tag", "left_anti"))


def append(init: DataFrame, full: DataFrame) -> DataFrame:
    """The first load and the rest, whose ids go on after the number of rows kept of the first."""
    n = init.agg(F.count("*")).scalar()
    return init.unionByName(full.withColumn("id", F.col("id") + n), allowMissingColumns=True)
