"""Substring dedup by a count-min prefilter and an exact second pass.

Pass 1: every task fills a sparse count-min sketch with its 13-word windows; the partial sketches are merged block by
block into two bitmaps "estimated twice or more". Counts are only ever overestimated, so no repeat is lost.
Pass 2: windows that both bitmaps let through are grouped exactly. Each Arrow batch first settles what it can by itself
and hands on one row for each distinct window, so that a window in a third of all documents makes one row a batch, not
one a document. Then ``min(doc_id)`` by window decides.

Defined results: a null or empty text has no words, nothing is removed and the kept text is empty. A document under 13
words has no window. Rows with a null doc_id neither remove nor lose words. Repeated rows (same doc_id and text) are
one document and get the same result; rows that share a doc_id but not the text are judged apart, neither removing words
of the other. Columns other than the id and the text pass through untouched unless they clash with a result's name, in
which case the result wins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as A
from .shared import drop_caches, gather_bits, has_bit, LOG_BLOCK

WINDOW_WORDS = 13
#: Sketch rows, and their width at most: 2 x 2**28 bits are 64 MB, broadcast. A corpus for which this is too narrow lets more windows through to the exact pass.
SKETCH_ROWS, MAX_LOG_WIDTH = 2, 28
ROW_FACTOR = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
FLUSH_KEYS = 2_000_000
#: Bytes of text whose words are hashed at a time.
HASHED_BYTES = 1 << 20


def _slots(keys: np.ndarray, row: int, log_width: int) -> np.ndarray:
    return ((keys * ROW_FACTOR[row]) >> np.uint64(64 - log_width)).astype(np.int64)


def _batch_windows(texts: pa.Array, k: int):
    """Chunks of (keys, row of each, word position of each)."""
    _, offs = A.string_buffers(texts)
    for r0, r1 in A.row_chunks(offs, HASHED_BYTES):
        codes, words, ends = A.split_words(texts.slice(r0, r1 - r0))
        if len(codes) < k:
            continue
        keys, at = A.word_windows(A.hash_strings(words)[codes], ends, k)
        row = np.repeat(np.arange(r1 - r0), np.diff(ends))[at]
        yield keys, row + r0, (at - ends[row]).astype(np.int32)


def _partial_sketch(k: int, log_width: int):
    log_block = min(LOG_BLOCK, log_width)

    def flush(held):
        keys = np.concatenate(held)
        blk, data = [], []
        for row in range(SKETCH_ROWS):
            slots = np.sort(_slots(keys, row, log_width))
            twice = np.zeros(len(slots), bool)
            twice[2:] = slots[2:] == slots[:-2]
            slots = slots[~twice]  # a counter saturates at two
            which = slots >> log_block
            cut = np.flatnonzero(np.diff(which, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(slots)], strict=True):
                blk.append((row << (log_width - log_block)) + int(which[a]))
                data.append(A.gaps_to_bytes(slots[a:b] & ((1 << log_block) - 1)))
        return pa.RecordBatch.from_arrays([pa.array(blk, pa.int32()), pa.array(data, pa.binary())], ["blk", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held, n = [], 0
        for batch in batches:
            for keys, _, _ in _batch_windows(batch.column(0), k):
                held.append(keys)
                n += len(keys)
                if n >= FLUSH_KEYS:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _merge_sketch(log_width: int):
    size = 1 << min(LOG_BLOCK, log_width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for blk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if blk not in once:
                    once[blk], twice[blk] = np.zeros(size, bool), np.zeros(size, bool)
                at = A.bytes_to_positions(data.as_buffer())
                twice[blk][at[once[blk][at]]] = True
                twice[blk][at[1:][at[1:] == at[:-1]]] = True
                once[blk][at] = True
        for blk, flags in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["blk", "bits"])

    return run


def repeated_sketch(docs: DataFrame, text: str, k: int, max_log_width: int = MAX_LOG_WIDTH) -> tuple[np.ndarray, int]:
    """Bitmaps of the counters that reach two over all documents, and the log of their width."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    log_width = min(max_log_width, max(16, int(size // 3).bit_length()))
    partial = docs.select(text).mapInArrow(_partial_sketch(k, log_width), "blk int, data binary")
    merged = partial.repartition("blk").mapInArrow(_merge_sketch(log_width), "blk int, bits binary")
    return gather_bits(merged, SKETCH_ROWS, log_width), log_width


def _candidates(k: int, bits, log_width: int):
    schema = pa.schema([("win", pa.int64()), ("own", pa.int64()), ("ver", pa.int64()), ("pos", pa.int32()), ("settled", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        maps = bits.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ver = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            for keys, row, pos in _batch_windows(batch.column(1), k):
                keep = np.ones(len(keys), bool)
                for r in range(SKETCH_ROWS):
                    at = np.flatnonzero(keep)
                    keep[at] = has_bit(maps[r], _slots(keys[at], r, log_width))
                parts.append((keys[keep], row[keep], pos[keep]))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            keys, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, ids[row], keys))
            keys, row, pos = keys[order], row[order], pos[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            owner = np.repeat(ids[row[first]], np.diff(np.append(first, len(keys))))
            later = ids[row] > owner
            mine = np.flatnonzero(~later)
            mine = mine[np.argsort(order[mine])]  # in the order of the text, neighbours repeat all but the window and shuffle files compress
            at = row[mine]
            yield pa.RecordBatch.from_arrays([pa.array(keys[mine].view(np.int64)), pa.array(ids[at]), pa.array(ver[at]), pa.array(pos[mine]), pa.nulls(len(mine), pa.binary())], schema=schema)
            if later.any():
                row, pos = row[later], pos[later]
                order = np.lexsort((pos, row))
                row, pos = row[order], pos[order]
                cut = np.flatnonzero(np.diff(row, prepend=-1))
                at = row[cut]
                data = [pos[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(pos)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(A.mix(ids[at].view(np.uint64)).view(np.int64)), pa.array(ids[at]), pa.array(ver[at]), pa.nulls(len(at), pa.int32()), pa.array(data, pa.binary())], schema=schema)

    return run


def _remove(k: int, with_text: bool, layout: bool):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, settled = batch.column(0), batch.column(1), batch.column(2)
            n_words, n_removed, sha, kept = [], [], [], []
            for i, text in enumerate(texts):
                words = split_ascii(text.as_py() or "")
                n, left = len(words), words
                found = [np.asarray(starts[i].values, np.int64)] if starts[i].is_valid else []
                found += [np.frombuffer(x, np.int32).astype(np.int64) for x in settled[i].as_py()] if settled[i].is_valid else []
                if found and len(at := np.concatenate(found)):
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + k, -1)
                    stays = np.cumsum(edge[:n]) == 0
                    left = [words[j] for j in np.flatnonzero(stays)]
                out = " ".join(left)
                n_words.append(n)
                n_removed.append(n - len(left))
                sha.append(hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest())
                if with_text:
                    kept.append(out if not layout else text.as_py() if len(left) == n else without_words(text.as_py(), stays))
            cols = dict(zip(batch.schema.names[3:], batch.columns[3:], strict=True)) | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    return run


def without_words(text: str, stays: np.ndarray) -> str:
    """A text without some of its words; all else is as it was, but a run of words goes with the white space behind it."""
    at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    starts, ends = A.runs(~stays)
    out, done = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(text[done : at[a]])
        done = at[b]
    return "".join(out) + text[done:]


_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def split_ascii(text: str) -> list[str]:
    """The words of a text; only ASCII white space parts them."""
    return [w for w in text.translate(_SPACES).split(" ") if w]


def _version(text: Column) -> Column:
    """24 bits of the text's hash tell rows apart that share a doc_id; more would only weigh on the shuffle."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("ver")


def repeated_starts(docs: DataFrame, k: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", max_log_width: int = MAX_LOG_WIDTH) -> DataFrame:
    """One row for each document that loses words: own, ver (fingerprint of its text), starts (array of int) and settled (array of binary int32)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("txt")).where("own is not null and txt is not null")
    bits, log_width = repeated_sketch(docs, "txt", k, max_log_width)
    shared = spark.sparkContext.broadcast(bits)
    rows = docs.select("own", "txt", _version(F.col("txt"))).mapInArrow(_candidates(k, shared, log_width), "win long, own long, ver long, pos int, settled binary")
    by_window = Window.partitionBy("win", F.col("pos").isNull())
    lost = rows.withColumn("first", F.min("own").over(by_window)).where("settled is not null or first < own")
    return lost.groupBy("own", "ver").agg(F.collect_list("pos").alias("starts"), F.collect_list("settled").alias("settled"))


def dedup(docs: DataFrame, k: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, max_log_width: int = MAX_LOG_WIDTH, keep: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """Removes each word covered by a k-word window that also starts in a document with a smaller id.

    Returns doc_id, the columns ``keep``, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the kept words
    joined by one space or, with ``layout``, the text as it was but for the removed words (a null text stays null).
    """
    results = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    keep = tuple(c for c in keep if c not in results)
    lost = repeated_starts(docs, k, id_col, text_col, max_log_width)
    rows = docs.select(F.col(text_col).alias("_txt"), F.col(id_col).cast("long").alias("own"), _version(F.col(text_col)), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep))).join(lost, ["own", "ver"], "left")
    rows = rows.select("_txt", "starts", "settled", F.col("own").alias("doc_id"), *(f"_{i}" for i in range(len(keep))))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:]] + ["n_words long", "n_removed long", "kept_sha256 string"] + ["kept_text string"] * with_text
    return rows.mapInArrow(_remove(k, with_text, layout), ", ".join(schema)).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
