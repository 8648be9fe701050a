"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LOG_BLOCK = 20
_CACHES = []


def process_cache(make):
    """Keeps what ``make`` gave last, in a worker process, until other work needs the memory."""
    cached = lru_cache(maxsize=1)(make)
    _CACHES.append(cached)
    return cached


def drop_caches() -> None:
    """What other operators have kept in this process: for tasks that begin a stage of their own and need room.

    What is freed stays with the process's allocators until they are asked for it.
    """
    if not any(cached.cache_info().currsize for cached in _CACHES):
        return
    for cached in _CACHES:
        cached.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a fresh temporary one where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gather_bits(blocks: DataFrame, rows: int, log_width: int) -> np.ndarray:
    """Collects (blk int, bits binary) into ``rows`` packed bitmaps of 2**log_width bits; the caller bounds log_width."""
    per = 1 << max(0, log_width - LOG_BLOCK)
    out = np.zeros((rows * per, (1 << min(LOG_BLOCK, log_width)) // 8), np.uint8)
    for r in blocks.toLocalIterator():
        out[r["blk"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(rows, -1)


def has_bit(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0
