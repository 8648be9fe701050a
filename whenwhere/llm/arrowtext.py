"""Vectorised helpers over Arrow string columns, used inside mapInArrow tasks.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. Null texts have no words and no bytes.
Fingerprints are 64-bit: a polynomial over random byte values modulo 2**64, mixed at the end.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 4 << 20
_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**64 - 1, 256, dtype=U64)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))
WORD_BASE = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def _powers(log_n: int, base: int) -> np.ndarray:
    out = np.full(1 << log_n, U64(base))
    out[0] = 1
    return np.cumprod(out)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables of power-of-two lengths are kept."""
    return _powers(max(16, int(n).bit_length()), int(base))[:n]


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string array; nulls are empty rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs.astype(np.int64)


def hash_strings(texts: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each whole string."""
    raw, offs = string_buffers(texts)
    n = len(offs) - 1
    out = np.zeros(n, U64)
    if n == 0:
        return out
    lens = np.diff(offs)
    full = lens > 0
    if full.any():
        data = raw[offs[0] : offs[-1]]
        within = np.arange(len(data), dtype=np.int64) - np.repeat(offs[:-1] - offs[0], lens)
        terms = BYTE_VALUE[data] * powers(int(lens.max()))[within]
        out[full] = np.add.reduceat(terms, (offs[:-1] - offs[0])[full])
    return mix(out + lens.astype(U64))


def row_chunks(offs: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of rows that hold about ``size`` bytes together; a longer row is alone."""
    r, n = 0, len(offs) - 1
    while r < n:
        e = max(r + 1, int(np.searchsorted(offs, offs[r] + size, side="right")) - 1)
        yield r, min(e, n)
        r = e


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Per word its code, the distinct words by code, and the rows' offsets into the words."""
    lists = pc.ascii_split_whitespace(texts if not texts.null_count else pc.fill_null(texts, ""))
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat, ends = flat.filter(full), seen[ends]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, ends


def word_windows(hashes: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all k-word windows that lie in one row, and the places where they start."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = hashes[: n - k + 1].copy()
    for j in range(1, k):
        acc *= WORD_BASE
        acc += hashes[j : n - k + 1 + j]
    room = np.repeat(ends[1:], np.diff(ends))[: n - k + 1] - np.arange(n - k + 1)
    at = np.flatnonzero(room >= k)
    return mix(acc[at]), at


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def gaps_to_bytes(sorted_positions: np.ndarray) -> bytes:
    """Ascending positions, repeats allowed, as one byte a gap; a byte of 255 adds 255 and goes on."""
    gap = np.diff(sorted_positions, prepend=0)
    more = gap // 255
    out = np.full(int(more.sum()) + len(gap), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out.tobytes()


def bytes_to_positions(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]
