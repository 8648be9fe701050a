"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents keep the order in which a task reads them. Windows of at most ``size`` tokens are cut at document ends (free),
sentence ends (a small truncation penalty) or, in sentences longer than a window, at word ends (a large one), so that
padding plus penalties is least: f[j] = min over i of f[i] + penalty[i] + padding(b[j] - b[i]). Padding falls linearly with the
window's length, so a monotone queue gives the minimum in constant time; windows of a power of two tokens need no
padding and are tried besides. Tasks pack on their own, with no shuffle: what a retry reads is what the first attempt read.
A task goes through its rows in parts (TOKENISED_BYTES); the last windows of a part are cut anew with the next, so sequences run on over
parts and batches, and what is held follows the size of a part or of one text, not of a batch.

Defined results: a null or empty text is its end id alone. Rows with a null or repeated doc_id are packed like any other.
An empty table gives no rows. Texts of any length are cut over several sequences. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .vocab import WordEncoder, default_path, word_encoder

SIZE, END_ID = 2048, 1
#: In padding tokens: a cut at a sentence end, a cut inside a sentence, and each further sequence.
SENTENCE_COST, WORD_COST, WINDOW_COST = 4, 64, 8
SMALLEST_POWER = 32
#: Bytes of text that are tokenised and packed at a time: the more, the fewer words are looked up twice, the more memory a task takes.
TOKENISED_BYTES = 2 << 20
#: The last windows of them stay open: their ends may change with what follows.
OPEN_WINDOWS = 16
#: Words whose ids a worker remembers, beside what other stages of a chain hold.
REMEMBER = 150_000


def tokenise(texts: pa.Array, encoder: WordEncoder, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids of the rows, the rows' offsets into them, and where sentences and words end in them."""
    codes, words, ends = A.split_words(texts)
    names = words.to_numpy(zero_copy_only=False).tolist()
    known = encoder.look_up(names)
    stop = np.fromiter((w[-1] in ".!?" for w in names), bool, len(names))
    n = encoder.words.size[known][codes] if len(codes) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    done = np.cumsum(n)
    total = np.concatenate([[0], done])
    offs = total[ends] + np.arange(len(ends))
    ids = np.full(int(offs[-1]), end_id, np.uint32)
    first = done - n + row
    if len(done):
        ids[np.repeat(first - (done - n), n) + np.arange(int(done[-1]))] = encoder.words.ids(known[codes])
    at = first + n
    return ids, offs, at[stop[codes]] if len(codes) else at, at


def boundaries(offs: np.ndarray, sentences: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where a window may end, from 0 to the last, and the penalty of a cut at each."""
    b = np.unique(np.concatenate([[0], offs, sentences]))
    gap = np.diff(b)
    if (gap > size).any():
        big = np.flatnonzero(gap > size)
        inner = words[np.concatenate([np.arange(*np.searchsorted(words, [b[i] + 1, b[i + 1]])) for i in big])] if len(words) else words
        b = np.unique(np.concatenate([b, inner]))
        big = np.flatnonzero(np.diff(b) > size)  # a word longer than a window is cut at even steps
        if len(big):
            b = np.unique(np.concatenate([b, *(np.arange(b[i], b[i + 1], size // 2) for i in big)]))
    cost = np.full(len(b), WORD_COST, np.int64)
    cost[np.isin(b, sentences)] = SENTENCE_COST
    cost[np.isin(b, offs)] = 0
    return b, cost


def cuts(b: np.ndarray, cost: np.ndarray, size: int) -> np.ndarray:
    """The window bounds of least total padding, penalties and windows; b[0] to b[-1]."""
    m = len(b)
    if m < 2:
        return b
    powers = [1 << k for k in range(SMALLEST_POWER.bit_length() - 1, size.bit_length() - 1)]
    exact: dict[int, list[int]] = {}
    for p in powers:
        at = np.searchsorted(b, b - p)
        for j in np.flatnonzero(b[np.minimum(at, m - 1)] == b - p).tolist():
            exact.setdefault(j, []).append(int(at[j]))
    places, pen = b.tolist(), cost.tolist()
    f, back = [0] * m, [0] * m
    queue: deque[tuple[int, int]] = deque([(places[0], 0)])  # (f + penalty + place, index), ascending in both
    for j in range(1, m):
        here = places[j]
        low = here - size
        while places[queue[0][1]] < low:
            queue.popleft()
        best, i = queue[0]
        best += size - here + WINDOW_COST
        for e in exact.get(j, ()):
            if (c := f[e] + pen[e] * (e > 0) + WINDOW_COST) < best:
                best, i = c, e
        f[j], back[j] = best, i
        key = best + pen[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [m - 1], m - 1
    while j:
        j = back[j]
        out.append(j)
    return b[out[::-1]]


class Open:
    """What a task has tokenised and not yet given out: ids, the places where windows may end with their penalties, and the documents.

    The first document may have begun before the ids held; its start is then below 0.
    """

    def __init__(self):
        self.ids = np.zeros(0, np.uint32)
        self.b = self.cost = np.zeros(1, np.int64)
        self.doc, self.start, self.total = pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, doc: pa.Array, ids: np.ndarray, offs: np.ndarray, sentences: np.ndarray, words: np.ndarray, size: int) -> None:
        base = len(self.ids)
        b, cost = boundaries(offs, sentences, words, size)
        self.ids, self.b, self.cost = np.append(self.ids, ids), np.append(self.b, b[1:] + base), np.append(self.cost, cost[1:])
        self.doc, self.start, self.total = pa.concat_arrays([self.doc, doc]), np.append(self.start, offs[:-1] + base), np.append(self.total, np.diff(offs))

    def drop(self, stop: int) -> None:
        """Forgets the ids before ``stop``, which is one of ``b``, and the documents that end there."""
        at = int(np.searchsorted(self.b, stop))
        row = int(np.searchsorted(self.start, stop, side="right")) - 1
        self.ids, self.b, self.cost = self.ids[stop:].copy(), self.b[at:] - stop, self.cost[at:].copy()
        self.doc, self.start, self.total = pa.concat_arrays([self.doc.slice(row)]), self.start[row:] - stop, self.total[row:].copy()


def pieces(held: Open, w: np.ndarray, sequence: int, names: list, with_ids: bool) -> pa.RecordBatch:
    """The pieces of documents in the windows between the places ``w``, from 0 on; the first window is number ``sequence``."""
    stop = w[-1]
    p = np.unique(np.concatenate([[0], held.start[(held.start > 0) & (held.start < stop)], w]))
    a, n = p[:-1], np.diff(p)
    row = np.searchsorted(held.start, a, side="right") - 1
    window = np.searchsorted(w, a, side="right") - 1
    little = held.ids.astype("<u4", copy=False)
    crc = [zlib.crc32(little[i:j]) for i, j in zip(a.tolist(), p[1:].tolist(), strict=True)]
    cols = [held.doc.take(pa.array(row)), pa.array(a - held.start[row]), pa.array(n), pa.array(crc, pa.int64()), pa.array(held.total[row]), pa.array(sequence + window), pa.array(a - w[window])]
    if with_ids:
        cols.append(pa.ListArray.from_arrays(pa.array(p, pa.int32()), pa.array(held.ids[:stop].view(np.int32))))
    return pa.RecordBatch.from_arrays(cols, schema=pa.schema(names))


def _pack(path: str, size: int, end_id: int, with_ids: bool, remember: int = REMEMBER):
    names = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    names += [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = word_encoder(path, remember), TaskContext.get().partitionId() << 36
        held = Open()
        for batch in batches:
            _, raw_offs = A.string_buffers(batch.column(1))
            for r0, r1 in A.row_chunks(raw_offs, TOKENISED_BYTES):
                held.add(batch.column(0).slice(r0, r1 - r0), *tokenise(batch.column(1).slice(r0, r1 - r0), encoder, end_id), size)
                if len(held.ids) > 2 * OPEN_WINDOWS * size:
                    w = cuts(held.b, held.cost, size)
                    w = w[: np.searchsorted(w, len(held.ids) - OPEN_WINDOWS * size, side="right")]
                    yield pieces(held, w, sequence, names, with_ids)
                    held.drop(int(w[-1]))
                    sequence += len(w) - 1
        if len(held.ids):
            yield pieces(held, cuts(held.b, held.cost, size), sequence, names, with_ids)

    return run


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, remember: int = REMEMBER) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ids.

    sequence_id says which task made it and is unique in one result. A worker remembers the ids of ``remember`` words; more take less time and more memory.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    path = vocabulary or default_path("word_bpe_49k.json")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pack(path, size, end_id, with_ids, remember), schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False, remember=4 * REMEMBER)
