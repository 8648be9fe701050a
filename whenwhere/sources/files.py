"""Files of the batch side: read pages, processed events, places, rules; write dated outputs and the four-part export."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import TagRules
from . import landed

EVENT = (
    "name string, short_name string, location string, sublocation string, description string, emoji string, lat double, lng double, tags array<string>, "
    "urls array<string>, url string, occurrences array<array<string>>"
)
LOCATION = "name string, short_name string, alternate_names array<string>, lat double, lng double, emoji string, tags array<string>"
WEBSITE = "name string, urls array<string>, crawl_frequency int, selector string, num_clicks int, js_code string, keywords string, max_pages int, disabled boolean, extra_tags array<string>"


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """crawl_date, site, source_url, body of root/YYYYMMDD/site.md; the first line is the address if it is one."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.col("_metadata.file_path"))
    first = F.substring_index("value", "\n", 1)
    is_url = first.startswith("http")
    return rows.select(
        F.regexp_extract("path", r"/(\d{8})[^/]*/[^/]+$", 1).alias("crawl_date"),
        F.regexp_extract("path", r"/([^/]+)\.md$", 1).alias("site"),
        F.when(is_url, F.trim(first)).alias("source_url"),
        F.when(is_url, F.substring(F.col("value"), F.length(first) + 2, F.length("value"))).otherwise(F.col("value")).alias("body"),
    )


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """Processed events; unreadable files are skipped, a lone url becomes the list of urls."""
    rows = spark.read.schema(EVENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED").json(root)
    urls = F.when(F.size("urls") > 0, F.col("urls")).when(F.coalesce("url", F.lit("")) != "", F.array("url")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("urls", urls).drop("url")


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCATION).option("multiLine", True).json(path)


def read_websites(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEBSITE).option("multiLine", True).json(path)


def _small_json(spark: SparkSession, path: str) -> dict:
    """A settings file; empty if it is missing or no JSON object. Other failures of the store are raised."""
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(source):
        return {}
    try:
        spec = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return {}
    return spec if isinstance(spec, dict) else {}


def read_tag_rules(spark: SparkSession, path: str) -> TagRules:
    """Rules of a JSON file; none if it is missing or broken."""
    spec = _small_json(spark, path)
    return TagRules(spec.get("rewrite", {}), tuple(spec.get("exclude", ())), tuple(spec.get("remove", ())))


def read_tag_display(spark: SparkSession, path: str) -> tuple[tuple[str, ...], dict[str, str]]:
    """Geotags in lower case, and colours by emoji or tag."""
    spec = _small_json(spark, path)
    return tuple(t.lower() for t in spec.get("geotags", ())), dict(spec.get("bgcolors", {}))


def read_related(spark: SparkSession, path: str) -> DataFrame:
    """(tag, related, weight) of a file that maps tags to lists of [tag, weight]; empty if it is missing or broken."""
    rows = [(tag, other, float(weight)) for tag, near in _small_json(spark, path).items() for other, weight in near]
    return spark.createDataFrame(rows, "tag string, related string, weight double")


def site_name(path, title: bool = False):
    """A page's site as its file is called: blanks for underscores, in lower case or as a title."""
    name = F.replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_"), F.lit(" "))
    return F.initcap(name) if title else F.lower(name)


def with_source_urls(extracted: DataFrame, pages: DataFrame) -> DataFrame:
    """Extracted tables (crawl_date, site) with the address of the page they come from, null where none was landed."""
    return extracted.join(pages.select("crawl_date", "site", "source_url"), ["crawl_date", "site"], "left")


def site_tags(websites: DataFrame, order: str | None = None) -> DataFrame:
    """(url_key, extra_tags): normal addresses of sites with tags of their own; the last site (by ``order``, else by name) wins."""
    pos = F.col(order or ("name" if "name" in websites.columns else "extra_tags"))
    rows = websites.where(F.size("extra_tags") > 0).select("extra_tags", pos.alias("pos"), F.explode("urls").alias("url"))
    return rows.groupBy(url_key(F.col("url")).alias("url_key")).agg(F.max_by("extra_tags", "pos").alias("extra_tags"))


def url_key(url):
    return F.lower(F.regexp_replace(url, "/+$", ""))


def follow_keywords(links: DataFrame, site: str, url: str, keywords: str, max_pages: int = 30) -> DataFrame:
    """Links that hold one of their site's comma-separated keywords, at most ``max_pages`` a site (the first by address)."""
    words = F.split(F.col(keywords), ",")
    hit = links.where(F.exists(words, lambda k: (F.trim(k) != "") & F.contains(F.col(url), F.trim(k))))
    return hit.withColumn("_r", F.row_number().over(Window.partitionBy(site).orderBy(url))).where(F.col("_r") <= max_pages).drop("_r")


def write_export(parts: tuple[DataFrame, DataFrame, DataFrame, DataFrame], root: str, order: tuple[str, str] = ("pos", "pos")) -> None:
    """init and full events (by first start, undated last), init and full locations, as numbered JSON arrays; ``order`` settles ties of events and orders locations."""
    for part, name in zip(parts, ("events.init", "events.full", "locations.init", "locations.full"), strict=True):
        first = [F.coalesce(F.col("first_start").cast("string"), F.lit("9999-99-99")), order[0]] if name.startswith("events") else [order[1]]
        landed.write_parts(part.orderBy(*first), f"{root}/{name}")


def archive(spark: SparkSession, path: str, archived: str) -> bool:
    """Moves a file or folder by the store's own rename and removes the folder it leaves if that is empty now; false if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(archived)
    store = source.getFileSystem(conf)
    if not store.exists(source):
        return False
    store.mkdirs(target.getParent())
    if not store.rename(source, target):
        raise OSError(f"{path} could not be moved to {archived}")
    if not len(store.listStatus(source.getParent())):
        store.delete(source.getParent(), False)
    return True
