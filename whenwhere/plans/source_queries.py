"""Registered queries of sources and sinks: what the tables give is written by a sink and read back by a source."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files, landed
from ..sources.stages import shared_root, staged
from . import extract
from . import model as M
from .view_queries import SPLIT, _split

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"with {M.SQL.strip()}\n{sql.strip()}" if sql.startswith("select") else sql
        return f

    return add


def _folder(spark, name):
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _pages(spark, d):
    rows = M.table(spark, d, "pages")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 5).cast("int")), "yyyyMMdd")
    return rows.select("page_id", date.alias("crawl_date"), F.concat(F.lit("Site: "), "page_id").alias("site"), F.col("url").alias("source_url"), F.col("html").alias("body"))


def _crawled(spark, d):
    root = _folder(spark, "crawled")
    landed.write_pages(_pages(spark, d), root)
    return landed.read_pages(spark, root)


LANDED = "p as (select *, strftime(date '2024-01-01' + (page_id % 5)::int, '%Y%m%d') as crawl_date, 'site_' || page_id as site from pages)"


@query(f"with {LANDED} select crawl_date, site, url as source_url, md5(html) as body_md5 from p where page_id % 5 >= 2 and site like 'site_1%'")
def q_landed_pages(spark, d):
    """Some dates and sites of all landed pages; folders and files of others are not read."""
    rows = _crawled(spark, d).where("crawl_date >= '20240103' and site like 'site_1%'")
    return rows.select("crawl_date", "site", "source_url", F.md5("body").alias("body_md5"))


TEMPLATE = "On {date} {name} ({url}) said: {content}\nNotes: {notes} {else}"


@query(
    f"""with {LANDED}, todo as (select * from p where page_id % 3 <> 0)
select crawl_date, site, url as source_url, md5('On ' || (date '2024-01-01' + (page_id % 5)::int)::varchar || ' Site ' || page_id || ' (' || url || ') said: ' || html || chr(10) || 'Notes: ' || case when page_id % 7 = 0 then 'mind the dates' else '' end || ' {{else}}') as prompt_md5,
  md5('{extract.HEAD.replace(chr(10), "' || chr(10) || '")}' || case when page_id % 2 = 0 then chr(10) || '| ' || url || ' |' || chr(10) || '| second |' else '' end) as table_md5 from todo"""
)
def q_extract_pending(spark, d):
    """Pages without a table yet, their prompts, and the tables of answers in two chunks or none."""
    pages, made, done = _crawled(spark, d), _pages(spark, d), _folder(spark, "extracted")
    landed.write_pages(made.where("page_id % 3 = 0"), done)
    todo = extract.pending(pages, landed.read_pages(spark, done))
    notes = made.where("page_id % 7 = 0").select(F.concat(F.lit("site_"), "page_id").alias("site"), F.lit("mind the dates").alias("notes"))
    asked = extract.prompts(todo, TEMPLATE, notes).select(*extract.KEYS, F.md5("prompt").alias("prompt_md5"))
    chunk = F.posexplode(F.array(F.concat(F.lit(extract.HEAD + "\n| "), "source_url", F.lit(" |")), F.lit(extract.HEAD + "\n| second |"))).alias("chunk_no", "text")
    answers = made.where("page_id % 2 = 0").select("crawl_date", F.concat(F.lit("site_"), "page_id").alias("site"), chunk)
    # tables are written, and found again with the address of the page they come from
    out = _folder(spark, "extracted")
    landed.write_pages(extract.tables(todo, answers).withColumn("source_url", F.lit(None)), out)
    tables = files.with_source_urls(landed.read_pages(spark, out).drop("source_url"), pages)
    return tables.join(asked, extract.KEYS).select(*extract.KEYS, "source_url", "prompt_md5", F.md5("body").alias("table_md5"))


@query(
    f"""with {M.SQL.strip()},\n{SPLIT}
select 'events.init' as part, id as ref, row_number() over (order by f, id) - 1 as position from init union all select 'events.full', id, row_number() over (order by f, id) - 1 from rest
union all select 'locations.init', loc_id, row_number() over (order by loc_id) - 1 from r5 join li using (a, b)
union all select 'locations.full', loc_id, row_number() over (order by loc_id) - 1 from r5 join lr using (a, b) where (a, b) not in (select (a, b) from li)"""
)
def q_export_order(spark, d):
    """The four parts of the export as they stand in their files."""
    root = _folder(spark, "export")
    # each part reads the events several times: for the ranges of its order, for its places, for itself
    files.write_export(_split(spark, d, lambda events: staged(events, "events")), root, ("id", "loc_id"))
    one = lambda name, ref: landed.positions(landed.read_parts(spark, f"{root}/{name}", f"{ref} long")).select(F.lit(name).alias("part"), F.col(ref).alias("ref"), "position")
    return functools.reduce(DataFrame.unionByName, [one("events.init", "id"), one("events.full", "id"), one("locations.init", "loc_id"), one("locations.full", "loc_id")])


@query("select name, short_name, lat, lng, tags[1] as first_tag from loc")
def q_gazetteer_scan(spark, d):
    root = _folder(spark, "places")
    landed.write_parts(M.locations(spark, d), root)
    return files.read_locations(spark, root).select("name", "short_name", "lat", "lng", F.get("tags", F.lit(0)).alias("first_tag"))


@query("with x as (select 'Site ' || page_id as name, [url, url || '/more'] as urls, (page_id % 9)::int as crawl_frequency, page_id % 4 = 0 as disabled from pages) select name, unnest(urls) as url, crawl_frequency, disabled from x")
def q_website_scan(spark, d):
    root, p = _folder(spark, "sites"), M.table(spark, d, "pages")
    sites = p.select(F.concat(F.lit("Site "), "page_id").alias("name"), F.array("url", F.concat("url", F.lit("/more"))).alias("urls"), (F.col("page_id") % 9).cast("int").alias("crawl_frequency"), (F.col("page_id") % 4 == 0).alias("disabled"))
    landed.write_parts(sites, root)
    return files.read_websites(spark, root).select("name", F.explode("urls").alias("url"), "crawl_frequency", "disabled")


@query("select name, lat, len(tags) as n_tags, case when id % 2 = 0 then 'https://e.org/' || id end as url from (select ev.id, ev.name || ' ' || ev.id as name, ev.tags, lat from ev join loc using (loc_id))")
def q_processed_scan(spark, d):
    """Processed events; a lone address becomes the list of addresses."""
    root = _folder(spark, "processed")
    rows = M.events(spark, d).join(M.locations(spark, d).select("loc_id", "lat", "lng"), "loc_id")
    landed.write_parts(rows.select(F.concat_ws(" ", "name", "id").alias("name"), "lat", "lng", "tags", F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://e.org/"), "id")).alias("url")), root)
    return files.read_events(spark, root).select("name", "lat", F.size("tags").cast("long").alias("n_tags"), F.get("urls", F.lit(0)).alias("url"))
