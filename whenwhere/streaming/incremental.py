"""Listings as they arrive: each file once, late rows by watermark, running counts, and loads that follow one another.

A load in phases (``append_batches``) writes each micro-batch into a folder of its own and then notes it in a log; readers see noted batches only. Ids are made
of the batch, the task and the row's place in it. A batch that fails on its way and is repeated writes its folder anew, so nothing is
there twice, and rows of a batch that never was noted are not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, root: str, schema: StructType, files_at_once: int = 64, name_filter: str | None = None) -> DataFrame:
    """A stream of parquet files under a folder; a file is read once, as the query's checkpoint remembers it."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(root)


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts(rows: DataFrame, key: str, at: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows by key and window of event time."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what has arrived, then stops; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Bits of an id: rows of a task, tasks of a batch.
ROW_BITS, TASK_BITS = 28, 16


def append_batches(stream: DataFrame, root: str, note=None) -> None:
    """Appends what has arrived to the table under ``root``, a batch at a time, with ids that go on from batch to batch; then stops."""
    note = note or _note

    def write(rows: DataFrame, batch: int) -> None:
        n = F.monotonically_increasing_id()  # the task's number above 33 bits, the row's place below
        task, place = F.shiftrightunsigned(n, 33), n.bitwiseAND((1 << 33) - 1)
        within = F.raise_error("a task of a batch has too many rows for its ids")
        own = F.when((place < 1 << ROW_BITS) & (task < 1 << TASK_BITS), F.lit(batch) * F.lit(1 << ROW_BITS + TASK_BITS) + F.shiftleft(task, ROW_BITS) + place).otherwise(within.cast("long"))
        rows.withColumn("id", own).write.mode("overwrite").parquet(f"{root}/batches/batch={batch}")
        note(rows.sparkSession, root, batch)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


def _note(spark: SparkSession, root: str, batch: int) -> None:
    spark.range(1).select(F.lit(batch).cast("long").alias("done")).write.mode("overwrite").parquet(f"{root}/log/batch={batch}")


def appended(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the batches in the log, with their id and batch."""
    done = [r["done"] for r in spark.read.parquet(f"{root}/log").select("done").collect()]  # one row a batch
    return spark.read.option("basePath", f"{root}/batches").parquet(*(f"{root}/batches/batch={b}" for b in sorted(done)))
