"""A corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; a changed text gets its new n_chars. SQL cannot express the near-duplicate stage, so the stages are tested on small
tables whose outcome is known, and the operators behind them against brute force.

Defined results, stage by stage: a null or empty text fails the quality rules (under 50 words), so it is in no later stage's input when run as
a chain; a stage that gets one keeps it as it is. Rows with a null id stay in near_dedup and lose no passages. Of rows that share an
id near_dedup keeps one: that of the class's first document, and of several texts under that id the least. Repeated rows are one
document. An empty table gives no rows. Columns other than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whenwhere.llm import packing, pii, probminhash, quality, substring_dedup
from whenwhere.llm.shared import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(rows: DataFrame, text: str) -> DataFrame:
    return rows.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are too frequent in their host.

    A line stays in its first document: a large group of near copies must leave one to the next stage.
    """
    judged = quality.apply_rules(docs, keep_first=True, keep=("text", "lang", "source"))
    return _columns(judged.where("kept"), "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates; rows without an id stay."""
    first = probminhash.classes(docs).where("doc_id is not null and doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS)).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; the rest keeps its lines and spaces."""
    return _columns(substring_dedup.dedup(docs, keep=("lang", "source"), layout=True), "kept_text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data."""
    return _columns(pii.replace_entities(docs, pii.corpus_key(spark), keep=("lang", "source")), "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_stage),
    ("personal_data", personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
