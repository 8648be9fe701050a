"""The batch side: rows of listings to grouped events, place matching, dedup and export splits."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.when import standard_time
from ..sources.stages import staged
from . import alike

HEADER = ["name", "location", "sublocation", "start_date", "start_time", "end_date", "end_time", "description", "url", "hashtags", "emoji"]


def parse_tables(pages: DataFrame, body: str = "body") -> DataFrame:
    """Rows of pipe tables: keeps the other columns, adds row_no and the eleven fields; rows of any other shape are dropped.

    Twelve cells are eleven if the fifth is a date (the name held a pipe); ten are eleven without the last if the line ends in a pipe.
    """
    lines = F.split(text.squeeze_ends(F.col(body)), "\n")
    rows = pages.select(*[c for c in pages.columns if c != body], F.posexplode(lines).alias("row_no", "line")).where("row_no >= 2")
    rows = rows.withColumn("line", text.squeeze_ends(F.col("line"))).where((F.col("line") != "") & ~F.col("line").startswith("|---"))
    cells = F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"(?U)\s*\|\s*")
    rows = rows.withColumn("c", F.transform(cells, text.squeeze_ends)).withColumn("n", F.size("c"))
    dated = F.to_date(F.try_to_timestamp(F.get("c", F.lit(4)), F.lit("yyyy-M-d"))).isNotNull()
    joined = F.concat(F.array(F.concat_ws(" | ", F.get("c", F.lit(0)), F.get("c", F.lit(1)))), F.slice("c", 3, 10))
    cells = F.when(F.col("n") == 11, F.col("c")).when((F.col("n") == 12) & dated, joined).when((F.col("n") == 10) & F.col("line").endswith("|"), F.array_append("c", F.lit("")))
    rows = rows.withColumn("c", cells).where("c is not null")
    fields = {h: F.get("c", F.lit(i)) for i, h in enumerate(HEADER)}
    fields |= {h: text.sanitize(fields[h]) for h in ("name", "description", "location", "sublocation")}
    fields["name"] = F.replace(F.replace(fields["name"], F.lit(r" \ |"), F.lit(":")), F.lit(r" \|"), F.lit(":"))
    return rows.withColumns(fields).drop("line", "c", "n")


def merge_chunks(chunks: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """One text for each key: the first chunk whole, later ones without what precedes their first rule line; no blank or rule lines of theirs."""
    cut = F.regexp_replace(body, r"(?s)^.*?\n?\|---[^\n]*\n?", "")
    later = F.array_join(F.filter(F.split(cut, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("|---")), "\n")
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    kept = chunks.withColumn("_t", F.when(first, F.col(body)).otherwise(later)).where("_t <> ''")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "\n").alias(body))


def cut_chunks(text_: str, size: int = 90_000, overlap: int = 0) -> list[str]:
    """Greedy slices of at most ``size``: cut at the last heading, else at the last blank line in the first nine tenths, else hard."""
    out, start, n = [], 0, len(text_)
    while start < n:
        end = start + size
        if end < n:
            head = text_.rfind("\n##", start, end)
            blank = text_.rfind("\n\n", start, end - size // 10)
            end = head if head > start else blank if blank > start else end
        out.append(text_[start:end])
        start = end - overlap if end - overlap > start else end
    return out


def chunk(docs: DataFrame, key: str, body: str, size: int = 90_000, overlap: int = 0) -> DataFrame:
    """(key, chunk_no, chunk) of every text; the cuts depend on each other, so a task walks through its texts, a part of a batch at a time."""

    def run(batches):
        for batch in batches:
            at = 0
            for n in text.part_sizes(batch.column(1)):
                part, at = batch.slice(at, n), at + n
                cuts = [cut_chunks(t, size, overlap) if t else [] for t in part.column(1).to_pylist()]
                of = np.repeat(np.arange(n), list(map(len, cuts)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array([i for c in cuts for i in range(len(c))], pa.int32()), pa.array([c for cut in cuts for c in cut], pa.string())], names=[key, "chunk_no", "chunk"])

    return docs.select(key, body).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_no int, chunk string")


def gazetteer(locations: DataFrame) -> DataFrame:
    """(tier, key, pos, place): lower-case and normal keys of names, other names and short names; the first place in order, the last value."""
    names = F.array(F.struct(F.lit(0).alias("tier"), F.array("name").alias("names")), F.struct(F.lit(1).alias("tier"), F.coalesce("alternate_names", F.array().cast("array<string>")).alias("names")), F.struct(F.lit(2).alias("tier"), F.array("short_name").alias("names")))
    rows = locations.select("pos", F.struct("lat", "lng", "emoji").alias("place"), F.explode(names).alias("t")).select("pos", "place", "t.tier", F.explode("t.names").alias("name")).where("name is not null")
    rows = rows.select("tier", "pos", "place", F.explode(F.array_distinct(F.array(F.lower("name"), text.normal_place(F.col("name"))))).alias("key")).where(F.length("key") >= 3)
    return rows.groupBy("tier", "key").agg(F.min("pos").alias("pos"), F.max_by("place", "pos").alias("place"))


def search_keys(rows: DataFrame) -> DataFrame:
    """Adds the normal forms n_loc, n_sub, n_name, n_full of a row's location, sublocation and name."""
    rows = rows.withColumns({"n_loc": text.normal_place(F.col("location")), "n_sub": text.normal_place(F.col("sublocation")), "n_name": text.normal_place(F.col("name"))})
    return rows.withColumn("n_full", F.trim(F.concat_ws(" ", "n_loc", "n_sub")))


def match_exact(rows: DataFrame, keys: DataFrame, row_id: str) -> DataFrame:
    """(row_id, tier, place): the best tier, then the place with its part, the place, the name."""
    tried = rows.select(row_id, F.posexplode(F.array("n_full", "n_loc", "n_name")).alias("k", "key")).where(F.length("key") > 3)
    met = tried.join(keys, "key")
    return met.groupBy(row_id).agg(F.min_by(F.struct("tier", "place"), F.struct("tier", "k")).alias("m")).select(row_id, "m.tier", "m.place")


def _pieces(column: Column, lengths: list[int]) -> Column:
    """The distinct substrings of the given lengths."""
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(column))
    return F.array_distinct(F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length(column) - n + 1), lambda i: F.substring(column, i, n)))))


def _lengths(strings: DataFrame) -> list[int]:
    """The lengths (over 3) that occur in a one-column table."""
    return sorted(r[0] for r in strings.select(F.length(strings.columns[0])).where(F.length(strings.columns[0]) > 3).distinct().collect())


def match_fuzzy(rows: DataFrame, keys: DataFrame, row_id: str, least: float = 0.85) -> DataFrame:
    """(row_id, score, tier, place): the best key that holds, or is held by, a row's place; an equal name scores 1.

    One of the two strings is a substring of the other, so the join is on whole strings: a row's substrings of the lengths that keys have,
    and keys' substrings of the lengths that rows' places have. Rows that read alike are matched once.
    """
    forms = ["n_full", "n_loc", "n_sub", "n_name"]
    keys = keys.where(F.trim("key") != "")
    names = keys.select("tier", "key")
    low = rows.select(row_id, *forms).where((F.length("n_full") > 3) | (F.length("n_name") > 3))
    once = low.select(*forms).distinct()
    held = once.select(*forms, F.explode(_pieces(F.col("n_full"), _lengths(keys.select("key")))).alias("key")).join(names, "key")
    parts = once.select(*forms, F.explode(F.array_distinct(F.array("n_loc", "n_sub", "n_name"))).alias("p")).where(F.length("p") > 3)
    holding = parts.join(names.select("tier", "key", F.explode(_pieces(F.col("key"), _lengths(parts.select("p")))).alias("p")), "p")
    equal = once.join(names, F.col("key") == F.col("n_loc"))
    key = F.col("key")
    named = (F.length("n_name") > 3) & (key == F.col("n_name"))
    edge = (F.length(key) > 3) & (F.startswith("n_full", key) | F.endswith("n_full", key))
    # a ratio of ``least`` bounds how far lengths are apart; the bound is cheap
    near = lambda c: F.abs(F.length(c) - F.length(key)) <= (1 - least) * (F.length(c) + F.length(key)) + 1e-9
    able = near("n_loc") | near("n_full") | ((F.length("n_name") > 3) & near("n_name"))
    pairs = [t.where(named | edge | able).select(*forms, "tier", "key") for t in (held, holding, equal)]
    pairs = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()
    inside = (key == F.col("n_loc")) | ((F.length(key) > 3) & F.contains("n_full", key)) | ((F.length("n_loc") > 3) & F.contains(key, F.col("n_loc"))) | ((F.length("n_sub") > 3) & F.contains(key, F.col("n_sub")))
    ratio = F.greatest(geo.edit_ratio(F.col("n_loc"), key), geo.edit_ratio(F.col("n_full"), key), F.when(F.length("n_name") > 3, geo.edit_ratio(F.col("n_name"), key)).otherwise(0.0))
    score = F.when(named, 1.0).when(edge, 0.9 + F.length(key) / F.length("n_full") * 0.09).otherwise(ratio)
    scored = pairs.where(named | edge | inside).withColumn("score", score).where(F.col("score") >= least).join(keys, ["tier", "key"])
    best = scored.groupBy(*forms).agg(F.min_by(F.struct("score", "tier", "place"), F.struct(-F.col("score"), "tier", "pos")).alias("m"))
    return low.join(best, forms).select(row_id, "m.score", "m.tier", "m.place")


def _segments(length: Column, edits: Column) -> Column:
    """(number, start, size) of the edits + 1 nearly even segments of a string."""
    n = edits + 1
    small = F.floor(length / n).cast("int")
    long = length - small * n  # so many of the last ones have one more
    start = lambda i: i * small + F.greatest(F.lit(0), i - (n - long))
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(i.alias("no"), start(i).alias("at"), (start(i + 1) - start(i)).alias("size")))


def alike_strings(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, score): distinct pairs of strings with an edit ratio of at least ``least``.

    Strings d edits apart share one of d + 1 segments of the right one, at most d places from where it stands, so they meet on lengths,
    segment and its text.
    """
    edits = lambda m, n: F.floor((1 - least) * (m + n) + 1e-9).cast("int")
    wide = (2 - least) / least
    others = lambda n: F.sequence(F.greatest(F.lit(1), F.floor(n / wide).cast("int")), F.ceil(n * wide).cast("int"))
    size = lambda c: F.length(c).cast("int")

    def cut(df: DataFrame, column: str, own: str, other: str) -> DataFrame:
        rows = df.select(column).where(F.length(column) > 0).distinct()
        rows = rows.select(column, size(column).alias(own), F.explode(others(size(column))).alias(other))
        return rows.where(F.abs(F.col(own) - F.col(other)) <= edits(F.col(own), F.col(other))).withColumn("d", edits(F.col(own), F.col(other)))

    r = cut(right, b, "nb", "na").select(b, "nb", "na", F.explode(_segments(F.col("nb"), F.col("d"))).alias("s"))
    r = r.select(b, "nb", "na", "s.no", F.substring(b, F.col("s.at") + 1, F.col("s.size")).alias("text"))
    l = cut(left, a, "na", "nb").select(a, "na", "nb", "d", F.explode(_segments(F.col("nb"), F.col("d"))).alias("s"))
    first, last = F.greatest(F.lit(0), F.col("s.at") - F.col("d")), F.least(F.col("na") - F.col("s.size"), F.col("s.at") + F.col("d"))
    l = l.where(first <= last).select(a, "na", "nb", "s.no", "s.size", F.explode(F.sequence(first, last)).alias("at"))
    l = l.select(a, "na", "nb", "no", F.substring(a, F.col("at") + 1, F.col("size")).alias("text")).distinct()
    pairs = l.join(r, ["na", "nb", "no", "text"]).select(a, b).distinct()
    return pairs.withColumn("score", geo.edit_ratio(F.col(a), F.col(b))).where(F.col("score") >= least)


def match_site(rows: DataFrame, keys: DataFrame, row_id: str, site: str, least: float = 0.85) -> DataFrame:
    """(row_id, score, tier, place) by the edit ratio of the site's name."""
    sites = rows.select(F.col(site).alias("_s")).distinct().withColumn("n_site", text.normal_place(F.col("_s"))).where("n_site <> ''")
    forms = keys.withColumn("n_key", text.normal_place(F.col("key"))).where("n_key <> ''")
    scored = alike_strings(sites, forms, "n_site", "n_key", least).join(forms, "n_key").join(sites, "n_site")
    best = scored.groupBy("_s").agg(F.min_by(F.struct("score", "tier", "place"), F.struct(-F.col("score"), "tier", "pos")).alias("m")).select("_s", "m.score", "m.tier", "m.place")
    return rows.select(row_id, F.col(site).alias("_s")).join(best, "_s").drop("_s")


def locate(rows: DataFrame, locations: DataFrame, row_id: str, site: str | None = None) -> DataFrame:
    """Adds place (lat, lng, emoji): exact tiers first, then fuzzy ones, then the site's name."""
    keys, keyed = gazetteer(locations), search_keys(rows)
    exact = match_exact(keyed, keys, row_id).select(row_id, "place")
    left = keyed.join(exact, row_id, "left_anti")
    fuzzy = match_fuzzy(left, keys, row_id).select(row_id, "place")
    found = exact.unionByName(fuzzy)
    if site:
        found = found.unionByName(match_site(left.join(fuzzy, row_id, "left_anti"), keys, row_id, site).select(row_id, "place"))
    return rows.join(found, row_id, "left")


def occurrence() -> Column:
    """[start_date, start_time, end_date, end_time] of a row; an end on the first day is none."""
    end = F.when(F.col("end_date") == F.col("start_date"), "").otherwise(F.coalesce("end_date", F.lit("")))
    return F.struct(F.coalesce("start_date", F.lit("")).alias("start_date"), standard_time(F.col("start_time")).alias("start_time"), end.alias("end_date"), standard_time(F.col("end_time")).alias("end_time"))


def group_exact(rows: DataFrame, file: str, order: str) -> DataFrame:
    """One event for each file and normal name: its first place in order, shortest name (the first of them), occurrences in order."""
    named = rows.withColumn("norm", text.normal_name(F.col("name"))).where(F.coalesce(F.col("name"), F.lit("")) != "").where(~text.is_cancelled(F.col("name")))
    once = named.withColumn("occ", occurrence()).groupBy(file, "norm", "occ").agg(F.min(order).alias("at"), F.min(F.struct(F.length("name").alias("n"), F.col(order).alias("at"), "name")).alias("best"))
    return once.groupBy(file, "norm").agg(F.min("at").alias("first_at"), F.min("best").alias("best"), F.array_sort(F.collect_list(F.struct("at", "occ"))).alias("occ")).select(
        file, "norm", "first_at", F.col("best.name").alias("name"), F.transform("occ", lambda x: x["occ"]).alias("occurrences")
    )


def group_fuzzy(rows: DataFrame, file: str, order: str) -> DataFrame:
    """(file, order, key_at): which row opened each row's group; groups are within a file, in order, by names that are alike."""
    named = rows.where(F.coalesce(F.col("name"), F.lit("")) != "").where(~text.is_cancelled(F.col("name")))
    return alike.group(named, file, order)


def dedup_exact(events: DataFrame, order: str = "pos") -> DataFrame:
    """One event for each place, first start and normal name: the shortest name, then the longest description, then the first; urls of all in order."""
    keyed = events.withColumn("norm", text.normal_name(F.col("name"))).withColumn("first_start", F.get("occurrences", F.lit(0))["start_date"])
    rank = F.struct(F.length("name"), -F.length(F.coalesce("description", F.lit(""))), F.col(order))
    return keyed.groupBy("lat", "lng", "first_start", "norm").agg(F.min_by(F.struct("name", "description", F.col(order).alias("pos")), rank).alias("e"), F.count("*").alias("n_merged")).select("lat", "lng", "first_start", "norm", "e.*", "n_merged")


def _plain(name: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (name or "").replace("_", "").strip().lower())).strip()


def _alike(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 5 and (a in b or b in a))


def greedy_dedup(names: list[str], lengths: list[int]) -> list[int]:
    """For each event in order (name, length of its description) the index of the one kept for it.

    An event joins the first kept one whose current name is alike; the shorter name stays, then the longer description. A name seen before
    goes where it went, unless a group has been renamed since.
    """
    plain_of: list[str] = []  # by group: its current plain name
    kept: list[int] = []
    renamed: list[int] = []  # groups, in the order of their renamings
    went: dict[str, tuple[int, int]] = {}  # plain name: its group, and how many renamings there had been
    group_of: list[int] = []
    for i, name in enumerate(names):
        plain = _plain(name)
        if plain in went:
            g, seen = went[plain]
            tried = sorted({g, *(j for j in renamed[seen:] if j < g)})
        else:
            g, tried = len(kept), range(len(kept))
        to = next((j for j in tried if _alike(plain, plain_of[j])), None)
        if to is None and plain in went:
            to = next((j for j in range(g + 1, len(kept)) if _alike(plain, plain_of[j])), None)
        if to is None:
            to = len(kept)
            kept.append(i)
            plain_of.append(plain)
        elif (len(name), -lengths[i]) < (len(names[kept[to]]), -lengths[kept[to]]):
            kept[to] = i
            if plain_of[to] != plain:
                plain_of[to] = plain
                renamed.append(to)
        went[plain] = (to, len(renamed))
        group_of.append(to)
    return [kept[g] for g in group_of]


def dedup_fuzzy(events: DataFrame, order: str = "pos") -> DataFrame:
    """(pos, kept_pos): for each event the one kept for it among those of its place and first start, greedily in order.

    A group's name is always one of its events', so only events whose names are linked by alike ones ever meet: each connected component of
    names is chosen from by itself. Names that are alike to no other need no choice beyond their own repeats. Repeats of name and description travel
    as one row with their places in the order.
    """
    # zero has one spelling; a place or day that is missing is one of its own
    spot = alike.spot(F.col("lat") + F.lit(0.0), F.col("lng") + F.lit(0.0), F.get("occurrences", F.lit(0))["start_date"])
    keyed = events.select(spot.alias("spot"), "name", F.length(F.coalesce("description", F.lit(""))).alias("n_description"), F.col(order).cast("long").alias("pos"), alike.plain_name(F.col("name")).alias("plain"))
    keyed = staged(keyed, "dedup")
    nodes = staged(keyed.groupBy("spot", "plain").agg(F.min("pos").alias("at")), "nodes")
    parts = alike.components(alike.alike(nodes, ["spot"]), ["spot"])
    met = keyed.join(nodes.join(parts, ["spot", "at"], "left").select("spot", "plain", F.coalesce("part", "at").alias("part")), ["spot", "plain"])
    once = met.groupBy("spot", "part", "name", "n_description").agg(F.collect_list("pos").alias("at"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.explode("at").sort_values("at")
        at = pdf["at"].astype("int64").to_numpy()
        return pd.DataFrame({"pos": at, "kept_pos": at[greedy_dedup(pdf["name"].tolist(), pdf["n_description"].tolist())]})

    # one name of one description: the first of its repeats stays
    several = F.count("*").over(Window.partitionBy("spot", "part")) > 1
    once = staged(once.withColumn("several", several), "parts")
    alone = once.where("not several").select(F.explode("at").alias("pos"), F.array_min("at").alias("kept_pos"))
    return alone.unionByName(once.where("several").groupBy("spot", "part").applyInPandas(run, "pos long, kept_pos long"))


def split_export(events: DataFrame, locations: DataFrame, as_of: Column, box=geo.INIT_BOX, days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(init events, other events, init locations, other locations): near and soon, and the complement."""
    soon = F.coalesce(F.col("first_start") < F.date_add(as_of, days), F.lit(False))
    near = geo.in_box(F.col("lat"), F.col("lng"), box)
    init, full = events.where(near & soon), events.where(~(near & soon))

    def active(e: DataFrame) -> DataFrame:
        at = e.select(F.round("lat", 5).alias("_a"), F.round("lng", 5).alias("_b")).distinct()
        return locations.join(at, (F.round(locations["lat"], 5) == F.col("_a")) & (F.round(locations["lng"], 5) == F.col("_b")), "left_semi")

    first = active(init)
    taken = first.select(F.round("lat", 5).alias("_a"), F.round("lng", 5).alias("_b")).distinct()
    rest = active(full)
    return init, full, first, rest.join(taken, (F.round(rest["lat"], 5) == F.col("_a")) & (F.round(rest["lng"], 5) == F.col("_b")), "left_anti")


def stale(sites: DataFrame, last: DataFrame, as_of: Column, default_days: int = 7) -> DataFrame:
    """Sites to read again: not disabled, never read or at least their frequency in days ago."""
    met = sites.where(~F.coalesce("disabled", F.lit(False))).join(last, "site", "left")
    return met.where(F.col("last_read").isNull() | (F.datediff(as_of, F.col("last_read")) >= F.coalesce("crawl_frequency", F.lit(default_days))))
