"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but little-endian ids, document after document, each closed by the end-of-document id. Files are cut into
byte ranges that tasks read on their own; in a range a vectorised comparison finds the separators. A document may begin ranges before
the one that closes it: a prefix scan over the ranges (sum of separators, greatest separator place), in two levels so that one
huge file is not one task, gives every range its first document's number and start.

``write_token_files`` makes such files from documents, one for each task, and returns which document is which: (file_no, ordinal,
doc_id). A task writes under a name of its attempt and renames it when complete, so a repeated task leaves one whole file.

Defined results: a null or empty text is a document of no tokens. Repeated rows and null ids are counted like any other. An empty
file or table gives no rows. Ids after the last separator are a last document with closed = false. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, shared_dir
from .vocab import default_path

END_ID, BLOCK_IDS, GROUP = 50256, 4 << 20, 1024
#: Fixed value: the byte-level vocabulary's pretoken pattern for tiktoken.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it; Spark writes local paths as file:/x."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _write(path: str, vocabulary: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        task = TaskContext.get()
        store, root = file_system(path)
        own = f"{root}/.part-{task.partitionId()}-{task.taskAttemptId()}"
        n = 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                for text in batch.column(1):
                    ids = np.array([*encode(text.as_py() or ""), end_id], dtype)
                    out.write(ids.tobytes())
                yield pa.RecordBatch.from_pydict({"file_no": pa.array([task.partitionId()] * batch.num_rows, pa.int32()), "ordinal": pa.array(np.arange(n, n + batch.num_rows)), "doc_id": batch.column(0)})
                n += batch.num_rows
        store.move(own, f"{root}/part-{task.partitionId():06d}.bin")

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes path/part-N.bin for each task and returns (file_no, ordinal, doc_id) of the documents in them."""
    store, root = file_system(path)
    store.create_dir(root, recursive=True)
    vocabulary = vocabulary or default_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(_write(path, vocabulary, end_id, dtype), "file_no int, ordinal long, doc_id long"), "manifest")


def _scan(end_id: int, dtype: str):
    width = np.dtype(dtype).itemsize
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = file_system(path)
                with store.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(n * width, start * width), dtype)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([len(ids)]), pa.array([np.flatnonzero(ids == end_id) + start], pa.list_(pa.int64()))], schema=schema)

    return run


def scan_counts(spark: SparkSession, path: str, end_id: int = END_ID, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the token files under a path."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", F.floor(F.col("length") / width).alias("ids")).where("ids > 0")
    last = F.floor((F.col("ids") - 1) / block_ids)
    blocks = files.select("path", "ids", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * block_ids).alias("start"), F.least(F.lit(block_ids), F.col("ids") - F.col("block") * block_ids).alias("n")).repartition("path", "block")
    seen = materialise(blocks.mapInArrow(_scan(end_id, dtype), "path string, block long, n long, ends array<long>"), "separators")
    each = seen.select("path", "block", F.floor(F.col("block") / GROUP).alias("grp"), F.size("ends").cast("long").alias("seps"), F.array_max("ends").alias("last_end"), "n")
    # level 2: groups of ranges; level 1: ranges of a group
    up = Window.partitionBy("path").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = each.groupBy("path", "grp").agg(F.sum("seps").alias("seps"), F.max("last_end").alias("last_end"))
    groups = groups.select("path", "grp", F.coalesce(F.sum("seps").over(up), F.lit(0)).alias("g_docs"), F.coalesce(F.max("last_end").over(up), F.lit(-1)).alias("g_end"))
    within = Window.partitionBy("path", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("b_docs", F.coalesce(F.sum("seps").over(within), F.lit(0))).withColumn("b_end", F.coalesce(F.max("last_end").over(within), F.lit(-1)))
    each = each.join(groups, ["path", "grp"]).select("path", "block", (F.col("g_docs") + F.col("b_docs")).alias("docs"), F.greatest("g_end", "b_end").alias("end"))
    met = seen.join(each, ["path", "block"])
    ends = F.transform("ends", lambda e, i: F.struct((F.col("docs") + i).alias("ordinal"), F.when(i == 0, F.col("end") + 1).otherwise(F.get("ends", i - 1) + 1).alias("start"), e.alias("stop")))
    done = met.select("path", F.explode(ends).alias("d")).select("path", "d.ordinal", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = seen.groupBy("path").agg(F.sum("n").alias("ids"), F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.array_max("ends")), F.lit(-1)).alias("end"))
    rest = whole.where("end + 1 < ids").select("path", "ordinal", (F.col("end") + 1).alias("start"), (F.col("ids") - F.col("end") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return done.unionByName(rest).withColumnRenamed("path", "file")


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every document, by way of token files in the shared folder."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, path, vocabulary, id_col=id_col, text_col=text_col)
    found = scan_counts(spark, path).withColumn("file_no", F.regexp_extract("file", r"part-(\d+)\.bin$", 1).cast("int"))
    return manifest.join(found, ["file_no", "ordinal"]).select("doc_id", "n_tokens", "file_no", "ordinal")


def op4(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in files of byte-level ids."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
