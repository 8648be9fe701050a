"""From landed pages to one table a page: what is still to be read, the prompts, and the tables made of the answers.

Who answers the prompts is outside the engine; ``tables`` takes the answers in chunks.

Defined results: a page that has a table, or no web address on its first line, is not read. A prompt's fields are filled in one pass, so text of a page that looks like a
field stays as it is; null fields are empty, braces of no field stay. A page without an answer, or with blank ones, gets the header alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import listing as L

KEYS = ["crawl_date", "site"]
HEAD = "| " + " | ".join(L.HEADER) + " |\n|" + "---|" * len(L.HEADER)


def pending(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """Pages with an address for which no table was made on their date."""
    return pages.where("source_url is not null").join(extracted.select(*KEYS), KEYS, "left_anti")


def prompt(template: str, **fields: Column) -> Column:
    """The template with each {field} replaced by its column."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, fields)) + r")\}", template) if fields else [template]
    return F.concat(*(F.coalesce(fields[p].cast("string"), F.lit("")) if n % 2 else F.lit(p) for n, p in enumerate(parts)))


def prompts(todo: DataFrame, template: str, notes: DataFrame | None = None) -> DataFrame:
    """Adds the prompt; ``notes`` are a line of advice for some sites (site, notes)."""
    rows = todo if notes is None else todo.join(notes.groupBy("site").agg(F.min("notes").alias("_notes")), "site", "left")
    note = F.lit("") if notes is None else F.col("_notes")
    made = prompt(template, url=F.col("source_url"), content=F.col("body"), date=F.to_date("crawl_date", "yyyyMMdd"), name=F.initcap(F.replace(F.col("site"), F.lit("_"), F.lit(" "))), notes=note)
    return rows.withColumn("prompt", made).drop("_notes")


def tables(todo: DataFrame, answers: DataFrame, head: str = HEAD) -> DataFrame:
    """(crawl_date, site, source_url, body): one table for each page, of its answers (crawl_date, site, chunk_no, text) in order."""
    asked = answers.join(todo.select(*KEYS), KEYS, "left_semi").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    # a struct as key: chunks are merged by page
    whole = L.merge_chunks(asked.select(F.struct(*KEYS).alias("page"), "chunk_no", "text"), "page", "chunk_no", "text").select("page.*", "text")
    return todo.select(*KEYS, "source_url").join(whole, KEYS, "left").select(*KEYS, "source_url", F.coalesce("text", F.lit(head)).alias("body"))
