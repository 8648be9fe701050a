"""A written trigram index over all that can be searched, and searches that read nothing else.

Entries (type, ref, text in search form) are numbered by block (by hash, some 32,000 entries or 4 million characters each) and place in the block. Of each text every run of
three characters is a gram; two end marks follow the text, so each character begins one. The posting of a gram in a block is the ascending
places of its entries, which Parquet's second format stores as packed deltas; as blocks bound it, a gram that every text has is many
postings and no long one. Postings lie sorted by gram in files of several blocks, so a search reads the row groups and pages of its grams; texts lie in a folder a
block, so it reads the blocks where something was found.

A term of three characters or more meets the places that all its grams share, and the text itself then tells (grams may stand apart in it).
A shorter term meets all grams that begin with it, which needs no telling. Search forms are made once, when the index is written, and of a
term on the driver: a search has no Python in its plan.

Defined results: entries whose text is null or empty are found by no term; an empty term finds nothing (callers show what matches then).
Entries that repeat are found as often as they are there. A null ref or type is kept. An empty table makes an empty index.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stages import staged

#: A block has about as many entries, or characters, at most; a task has that many blocks once there are more than tasks.
BLOCK_LETTERS, TASK_BLOCKS = 1 << 22, 8
BLOCK_ROWS, GRAM, END = 1 << 15, 3, "￿"
#: Grams that a search looks up at most: the text decides anyway, so any of a term's grams may stand for it.
MOST_GRAMS = 12
TEXTS = "place int, type string, ref string, text string, block int"
POSTINGS = "gram string, block int, n int, places array<int>"


def term_form(term: str) -> str:
    """A term in search form: lower case, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", term) if not "̀" <= c <= "ͯ").lower()


def grams_of(form: str) -> list[str]:
    """The term's grams to look up: all of them, or some from its whole length."""
    found = list(dict.fromkeys(form[i : i + GRAM] for i in range(len(form) - GRAM + 1)))
    return found if len(found) <= MOST_GRAMS else [found[i * (len(found) - 1) // (MOST_GRAMS - 1)] for i in range(MOST_GRAMS)]


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.schema(TEXTS).parquet(f"{self.path}/texts")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def places(self, term: str) -> DataFrame:
        """(block, place) of the entries that may hold a term, which is not empty, in search form."""
        if len(term) < GRAM:
            return self.postings.where(F.startswith("gram", F.lit(term))).select("block", F.explode("places").alias("place")).distinct()
        grams = grams_of(term)
        shared = self.postings.where(F.col("gram").isin(grams)).groupBy("block").agg(F.collect_list(F.struct("n", "places")).alias("all"))
        # from the shortest posting on; a block has at most as many postings as the term has grams
        ordered = shared.where(F.size("all") == len(grams)).select("block", F.array_sort("all").alias("all"))
        both = F.aggregate(F.slice("all", 2, len(grams)), F.get("all", F.lit(0))["places"], lambda a, b: F.array_intersect(a, b["places"]))
        return ordered.select("block", F.explode(both).alias("place"))

    def find(self, term: str) -> DataFrame:
        """(type, ref, is_whole) of the entries whose text holds the term; is_whole if it is all of the text."""
        form = term_form(term)
        if not form:
            return self.texts.where("false").select("type", "ref", F.lit(False).alias("is_whole"))
        met = self.texts.join(self.places(form), ["block", "place"])
        return met.where(F.contains("text", F.lit(form))).select("type", "ref", (F.col("text") == form).alias("is_whole"))


def _postings(block: tuple[pa.Scalar], texts: pa.Table) -> pa.Table:
    """The postings of one block: its grams as whole numbers (21 bits a character), sorted, each with the places where it stands."""
    texts = texts.sort_by("place")
    words = texts["text"].to_pylist()
    n = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(w + END * (GRAM - 1) for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    # all that begin at a character, none that begins at an end mark
    ends = np.cumsum(n + GRAM - 1)
    begins = np.ones(len(letters), bool)
    for i in range(1, GRAM):
        begins[ends - i] = False
    at = np.flatnonzero(begins)
    grams = (letters[at] << 42) | (letters[at + 1] << 21) | letters[at + 2]
    places = np.repeat(texts["place"].to_numpy().astype(np.int32), n)
    order = np.argsort(grams, kind="stable")
    grams, places = grams[order], places[order]
    once = np.ones(len(grams), bool)
    once[1:] = (grams[1:] != grams[:-1]) | (places[1:] != places[:-1])
    grams, places = grams[once], places[once]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    of = grams[first]
    spelt = np.stack([of >> 42, (of >> 21) & 0x1FFFFF, of & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    offsets = np.r_[first, len(grams)].astype(np.int32)
    return pa.table(
        {
            "gram": [spelt[i : i + GRAM] for i in range(0, len(spelt), GRAM)], "block": pa.array(np.full(len(of), block[0].as_py(), np.int32)),
            "n": pa.array(np.diff(offsets)), "places": pa.ListArray.from_arrays(pa.array(offsets), pa.array(places)),
        }
    )


def postings_of(texts: DataFrame, n_tasks: int) -> DataFrame:
    """The postings of all blocks; what is shuffled is the texts, by block."""
    return texts.select("block", "place", "text").repartition(n_tasks, "block").groupBy("block").applyInArrow(_postings, POSTINGS)


def write(entries: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> SearchIndex:
    """Writes the index of (type, ref, text) under a folder that does not exist.

    Entries are worked out once. They are shuffled by block to be numbered, and their texts again to be cut into grams: a block's grams are counted where
    its texts are, so pairs of gram and place are never shuffled. Each task's postings are one file sorted by gram.
    """
    spark = entries.sparkSession
    entries = staged(entries.select("type", "ref", "text").where(F.coalesce("text", F.lit("")) != ""), "entries")
    n, letters = entries.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    n_blocks = max(1, -(-n // block_rows), -(-letters // BLOCK_LETTERS))
    n_tasks = min(n_blocks, max(2 * spark.sparkContext.defaultParallelism, -(-n_blocks // TASK_BLOCKS)))
    # the text is part of the order: the numbers of a retry are those of the first attempt
    block = F.pmod(F.xxhash64("type", "ref", "text"), F.lit(n_blocks)).cast("int")
    rows = entries.withColumn("block", block).repartition(n_tasks, "block")
    place = F.row_number().over(Window.partitionBy("block").orderBy("type", "ref", "text")) - 1
    numbered = rows.withColumn("place", place).select("place", "type", "ref", "text", "block")
    numbered.write.partitionBy("block").parquet(f"{path}/texts")
    index = SearchIndex(spark, path)

    postings_of(index.texts, n_tasks).sortWithinPartitions("gram", "block").write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    return index
