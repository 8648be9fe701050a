"""Counts kept up to date by signed changes, so that a small change of the filters costs what it changes.

``Counts`` is a table of n by keys in files: a base and later changes, dealt by a hash of the keys to folders. A change of some keys reads the folders of its own
keys only and tells which keys came (n was zero) and which went (n is zero now). ``Facets`` chains three of them: occurrences within the window by event,
matching events by tag and place, and places by tag. A window that moves reads the occurrences that it gains and those that it loses; the
events that came or went are looked up by id. A ``Facets`` follows either windows or sets of ids.

A version is written whole before an object names it; one that fails on its way leaves the earlier object as it was. Each change adds a version, and
after ``MOST_VERSIONS`` the folders are written together.

Defined results: changes of one key in a batch are summed; keys that come out as zero have no row. A sum below zero means that something
went that never came, and is raised. Null keys are keys. Empty changes change nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import staged

BUCKETS = 64
MOST_VERSIONS = 16


@dataclass(frozen=True)
class Counts:
    spark: SparkSession
    root: str
    keys: tuple[tuple[str, str], ...]  # name and type
    versions: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [k for k, _ in self.keys]

    def _log(self, buckets: list[int] | None = None) -> DataFrame:
        schema = ", ".join(f"`{k}` {t}" for k, t in self.keys) + ", d long, bucket int"
        if not self.versions:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}").parquet(*(f"{self.root}/version={v}" for v in self.versions))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def table(self) -> DataFrame:
        """(keys, n) of all keys that are counted."""
        return self._log().groupBy(*self.names).agg(F.sum("d").alias("n")).where("n <> 0")

    def changed(self, changes: DataFrame) -> tuple[Counts, DataFrame]:
        """The counts after changes (keys, d), and (keys, was, now) of the keys whose count is another one."""
        found = changes.groupBy(*self.names).agg(F.sum("d").alias("d")).where("d <> 0").withColumn("bucket", F.pmod(F.xxhash64(*self.names), F.lit(BUCKETS)).cast("int"))
        delta = staged(found, "delta")
        touched = [r["bucket"] for r in delta.select("bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            return self, delta.select(*self.names, F.lit(0).cast("long").alias("was"), F.lit(0).cast("long").alias("now"))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.names]
        old = self._log(touched).alias("a").join(delta.alias("b"), same, "left_semi").select(*self.names, F.col("d").alias("was"), F.lit(0).cast("long").alias("d"))
        both = old.unionByName(delta.select(*self.names, F.lit(0).cast("long").alias("was"), "d")).groupBy(*self.names).agg(F.sum("was").alias("was"), F.sum("d").alias("d"))
        now = F.when(F.col("was") + F.col("d") >= 0, F.col("was") + F.col("d")).otherwise(F.raise_error("more went than ever came").cast("long"))
        seen = staged(both.select(*self.names, "was", now.alias("now")), "changed")
        return self._with(delta), seen

    def _with(self, rows: DataFrame) -> Counts:
        version = uuid.uuid4().hex
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/version={version}")
        grown = replace(self, versions=(*self.versions, version))
        return grown if len(grown.versions) <= MOST_VERSIONS else grown.together()

    def together(self) -> Counts:
        """The same counts in one version."""
        rows = self._log().groupBy("bucket", *self.names).agg(F.sum("d").alias("d")).where("d <> 0")
        return replace(self, versions=())._with(rows)


def crossings(seen: DataFrame) -> DataFrame:
    """(keys, d): 1 for keys that came, -1 for those that went."""
    came = F.when((F.col("was") == 0) & (F.col("now") > 0), 1).when((F.col("was") > 0) & (F.col("now") == 0), -1)
    return seen.withColumn("d", came.cast("long")).where("d is not null").drop("was", "now")


Window = tuple[Column, Column]


def moved(occurrences: DataFrame, old: Window | None, new: Window) -> DataFrame:
    """(id, d): 1 for each occurrence (id, start, end) that only the new window meets, -1 for each that only the old one did.

    Each case is a range of starts or ends, which reaches the scan; what both windows meet is not read where the table is sorted by time.
    """
    start, end = F.col("start"), F.col("end")
    met = lambda w: (start <= w[1]) & (end >= w[0])
    one = lambda rows, d: rows.select("id", F.lit(d).cast("long").alias("d"))
    if old is None:
        return one(occurrences.where(met(new)), 1)
    only = lambda w, other: [occurrences.where(met(w) & (start > other[1])), occurrences.where(met(w) & (end < other[0]) & (start <= other[1]))]
    gained, lost = only(new, old), only(old, new)
    return one(gained[0], 1).unionByName(one(gained[1], 1)).unionByName(one(lost[0], -1)).unionByName(one(lost[1], -1))


@dataclass(frozen=True)
class Facets:
    """How many places each tag has among the matching events, for a window of dates that may move."""

    events: Counts
    pairs: Counts
    tags: Counts
    window: Window | None = None

    @classmethod
    def start(cls, spark: SparkSession, root: str, id_type: str = "long", loc_type: str = "long") -> Facets:
        make = lambda name, *keys: Counts(spark, f"{root}/{name}", keys)
        return cls(make("events", ("id", id_type)), make("pairs", ("tag", "string"), ("loc_id", loc_type)), make("tags", ("tag", "string")))

    def at(self, events: DataFrame, occurrences: DataFrame, window: Window) -> Facets:
        """The facets of another window, by what it gains and loses; events have id, loc_id and tags."""
        if self.window is None and self.events.versions:
            raise ValueError("these facets follow sets of ids")
        counted, seen = self.events.changed(moved(occurrences, self.window, window))
        return replace(self._next(events, crossings(seen)), events=counted, window=window)

    def of(self, events: DataFrame, ids: DataFrame) -> Facets:
        """The facets of any set of ids, such as a written tag index gives; only events that came or went are counted."""
        if self.window is not None:
            raise ValueError("these facets follow windows")
        gone = self.events.table().select("id", (-F.col("n")).alias("d"))
        counted, seen = self.events.changed(gone.unionByName(ids.select("id").distinct().withColumn("d", F.lit(1).cast("long"))))
        return replace(self._next(events, crossings(seen)), events=counted)

    def _next(self, events: DataFrame, changes: DataFrame) -> Facets:
        tagged = events.select("id", "loc_id", F.explode(F.array_distinct("tags")).alias("tag")).join(changes, "id").select("tag", "loc_id", "d")
        pairs, seen = self.pairs.changed(tagged)
        tags, _ = self.tags.changed(crossings(seen))
        return replace(self, pairs=pairs, tags=tags)

    def frequency(self, words: DataFrame) -> DataFrame:
        """(tag, frequency) of a vocabulary, zero for the rest of it."""
        return words.join(self.tags.table(), "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("frequency"))
