"""A written tag index: for each tag the ids that have it, in blocks of 65,536 ids, and filters that work block by block.

A posting is a block's ascending places, which Parquet's second format packs to the bits that their gaps need: one or two a place where a tag
is dense. As blocks bound a posting, a tag that every event has is many short rows. All ids are kept under no tag, for filters that only
forbid. Postings lie sorted by tag and block, so a filter reads the row groups of its tags; a block meets only its own postings, at most one a tag that
the filter names, and is settled with set functions on arrays. No event is read.

Defined results: an id that repeats counts once; events without tags are among all ids only; null tags and null ids are left out. Tags that are not in
the index have no ids. An empty table makes an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import strings
from .view import TagStates

LOG_BLOCK = 16
POSTINGS = "tag string, block long, n int, places array<int>"


@dataclass(frozen=True)
class TagIndex:
    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def stats(self) -> DataFrame:
        """(tag, n_events, first_id, last_id), from the blocks' ends and sizes."""
        first, last = _ids(F.col("block"), F.get("places", F.lit(0))), _ids(F.col("block"), F.get("places", F.col("n") - 1))
        return self.postings.where("tag is not null").groupBy("tag").agg(F.sum("n").alias("n_events"), F.min(first).alias("first_id"), F.max(last).alias("last_id"))

    def matching(self, states: TagStates) -> DataFrame:
        """(id) of the events with none of the forbidden tags and all required ones, or else any selected or implicit one if there are some."""
        any_of = () if states.required else states.selected + states.implicit
        named = sorted({*states.required, *any_of, *states.forbidden})
        whole = not states.required and not any_of
        rows = self.postings.where((F.col("tag").isin(named) if named else F.lit(False)) | (F.col("tag").isNull() if whole else F.lit(False)))
        blocks = rows.groupBy("block").agg(F.collect_list(F.struct("n", "tag", "places")).alias("all"))
        of = lambda tags: F.array_sort(F.filter("all", lambda x: F.coalesce(F.array_contains(strings(sorted(set(tags))), x["tag"]), F.lit(False))))
        union = lambda tags: F.array_distinct(F.flatten(F.transform(of(tags), lambda x: x["places"])))
        if states.required:  # from the shortest posting on
            found = of(states.required)
            shared = F.aggregate(F.slice(found, 2, len(named)), F.get(found, F.lit(0))["places"], lambda a, b: F.array_intersect(a, b["places"]))
            places = F.when(F.size(found) == len(set(states.required)), shared)
        elif any_of:
            places = union(any_of)
        else:
            places = F.get(F.filter("all", lambda x: x["tag"].isNull()), F.lit(0))["places"]
        if states.forbidden:
            places = F.array_except(places, union(states.forbidden))
        return blocks.select("block", F.explode(places).alias("place")).select(_ids(F.col("block"), F.col("place")).alias("id"))


def _ids(block: Column, place: Column) -> Column:
    return F.shiftleft(block, LOG_BLOCK) + place


def write(pairs: DataFrame, ids: DataFrame, path: str) -> TagIndex:
    """Writes the index of (tag, id) and of all ids under a folder that does not exist."""
    spark = pairs.sparkSession
    every = pairs.where("tag is not null").select("tag", "id").unionByName(ids.select(F.lit(None).cast("string").alias("tag"), "id")).where("id is not null")
    block = F.shiftright("id", LOG_BLOCK)
    rows = every.select("tag", block.alias("block"), (F.col("id") - F.shiftleft(block, LOG_BLOCK)).cast("int").alias("place"))
    lists = rows.groupBy("tag", "block").agg(F.sort_array(F.collect_set("place")).alias("places")).select("tag", "block", F.size("places").alias("n"), "places")
    lists.repartitionByRange("tag", "block").sortWithinPartitions("tag", "block").write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    return TagIndex(spark, path)
