"""Exact substring dedup over bytes: a suffix array made blockwise, one suffix bucket at a time, with a difference cover.

Every suffix of at least ``length`` bytes goes to a bucket by content: the least 32-byte gram in its first ``length`` bytes (its
anchor). Equal strings so meet in one bucket at one distance from the anchor, and neighbouring suffixes of one text share an anchor and
travel as one fragment, which holds their text. A task reads its buckets in order and sorts them one at a time (small ones
together, up to BLOCK bytes): the block's cover samples are ranked, then its suffixes are sorted, long ties being settled by
those ranks (see suffix_sort). Strings next to each other that agree in ``length`` bytes are repeats. A bucket with one fragment has none.

A first pass counts the fragments of each gram. Those of grams that occur once hold no repeat and do not travel: the others make a bitmap
(at most 2**MAX_LOG_BITS bits, broadcast; where the corpus outgrows it, more fragments travel). Buckets of frequent grams are dealt to
several tasks; such buckets, and any that outgrow a block, are sorted in parts, and each part hands on one occurrence of each string
to a last grouping by the string's fingerprint. So memory is bounded by BLOCK. Each chunk of a batch (CHUNK) first settles fragments that it
holds twice, so that a passage in a third of all documents makes one fragment a chunk.

Defined results: a null text is empty: no bytes, spans or removals. Texts under ``length`` bytes keep all. Rows with a
null id take no part and keep all. Rows that repeat id and text are copies of each other like any two rows, so both lose
all their strings. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .shared import LOG_BLOCK, gather_bits, has_bit, materialise
from .suffix_sort import Bytes, cover_tables, groups_of, sort_block

LENGTH, COVER_R, GRAM = 400, 2, 32
CHUNK = 2 << 20
#: Bytes of fragments that a task sorts at a time.
BLOCK = 3 << 20
#: A gram with more fragments is frequent; its bucket is dealt to tasks of about as many. At most MOST_FREQUENT grams are broadcast (3 MB).
FREQUENT, MOST_FREQUENT = 1000, 200_000
MAX_LOG_BITS, BITS_A_GRAM = 29, 2
LOW = np.uint64((1 << 24) - 1)


def _chunks(offs: np.ndarray, overlap: int):
    """(first row, last row, lo, hi, end of starts): whole rows, or parts of one long row that overlap."""
    for r0, r1 in A.row_chunks(offs, CHUNK):
        lo, hi = int(offs[r0]), int(offs[r1])
        if r1 - r0 > 1 or hi - lo <= 2 * CHUNK:
            yield r0, r1, lo, hi, hi
        else:
            for a in range(lo, hi, CHUNK):
                yield r0, r1, a, min(hi, a + CHUNK + overlap), min(hi, a + CHUNK)


class Runs:
    """The runs of suffix starts of a chunk that share an anchor: row, first start, number and anchor of each, in chunk positions."""

    def __init__(self, raw, offs, r0, r1, lo, hi, stop, length):
        self.base, self.text = lo, Bytes(raw[lo:hi])
        n = hi - lo
        cuts = np.clip(offs[r0 : r1 + 1], lo, hi) - lo
        room = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(n)
        at = np.flatnonzero(room[: stop - lo] >= length)
        if not len(at):
            self.start = self.count = self.anchor = self.row = at
            return
        # the least gram of each window, its place in the low bits, so that the first of equal ones wins
        g = A.mix(self.text.prints(np.arange(n - GRAM + 1), GRAM)) & ~LOW | np.arange(n - GRAM + 1, dtype=np.uint64)
        w, m = length - GRAM + 1, len(g)
        g = np.concatenate([g, np.full(-m % w + w, 2**64 - 1, np.uint64)]).reshape(-1, w)
        before = np.minimum.accumulate(g, axis=1).reshape(-1)
        after = np.minimum.accumulate(g[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(after[at], before[at + w - 1]) & LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
        cut = np.flatnonzero(new)
        self.start, self.anchor = at[cut], anchor[cut]
        self.count = np.diff(np.append(cut, len(at)))
        self.row = r0 + np.searchsorted(cuts, self.start, side="right") - 1

    def buckets(self) -> np.ndarray:
        return A.mix(self.text.prints(self.anchor, GRAM)).view(np.int64)


def _anchors(length: int):
    """(bucket, n): the fragments of each gram in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = A.string_buffers(batch.column(0))
            found = [Runs(raw, offs, *x, length).buckets() for x in _chunks(offs, length)]
            if found and len(all_ := np.concatenate(found)):
                bucket, n = np.unique(all_, return_counts=True)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket), "n": pa.array(n)})

    return run


FRAGMENTS = pa.schema([("bucket", pa.int64()), ("salt", pa.int32()), ("own", pa.int64()), ("ver", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32()), ("told", pa.bool_()), ("data", pa.binary())])
FOUND = pa.schema([("blk", pa.int32()), ("own", pa.int64()), ("ver", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("data", pa.binary())])
#: A string of a bucket that is sorted in parts; about STRINGS of them make a block of the last grouping.
STRING = np.dtype([("key", "<u8"), ("own", "<i8"), ("ver", "<i8"), ("pos", "<i8"), ("told", "?")])
STRINGS = 1 << 20


def _slots(bucket: np.ndarray, log_bits: int):
    """A gram's bits, all in one block of the bitmap."""
    log_block = min(LOG_BLOCK, log_bits)
    key = bucket.view(np.uint64)
    block = (key >> np.uint64(63 - (log_bits - log_block)) >> np.uint64(1)).astype(np.int64) << log_block
    for _ in range(BITS_A_GRAM):
        key = A.mix(key + np.uint64(1))
        yield block | (key >> np.uint64(64 - log_block)).astype(np.int64)


def _bitmap(log_bits: int):
    """Grams, dealt by block, to the blocks' bits."""
    log_block = min(LOG_BLOCK, log_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            for slots in _slots(batch.column(0).to_numpy(), log_bits):
                for blk in np.unique(slots >> log_block).tolist():
                    flags.setdefault(blk, np.zeros(1 << log_block, bool))[slots[slots >> log_block == blk] & ((1 << log_block) - 1)] = True
        for blk, f in flags.items():
            yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([np.packbits(f).tobytes()], pa.binary())], ["blk", "bits"])

    return run


def _fragments(length: int, shared):
    """One fragment for each run of a chunk; those that it holds twice are told of, and travel once. Told runs also come without text, in no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, parts, bits, log_bits = shared.value
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ver = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offs = A.string_buffers(batch.column(0))
            for x in _chunks(offs, length):
                c = Runs(raw, offs, *x, length)
                if not len(c.start):
                    continue
                bucket, again = c.buckets(), np.ones(len(c.start), bool)
                for slots in _slots(bucket, log_bits):
                    again &= has_bit(bits, slots)
                bucket, start, count, anchor, row = (x[again] for x in (bucket, c.start, c.count, c.anchor, c.row))
                if not len(start):
                    continue
                size = count + length - 1
                whole = A.mix(c.text.prints(start, size) + count.astype(np.uint64)) ^ bucket.view(np.uint64)
                _, first, of, seen = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                told = seen[of] > 1
                own, own_ver, pos = ids[row], ver[row], c.base + start - offs[row]
                salt = np.zeros(len(own), np.int32)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, bucket), len(grams) - 1)
                    hot = grams[at] == bucket
                    spread = A.mix(own.view(np.uint64) + pos.view(np.uint64) * A.WORD_BASE)
                    salt[hot] = 1 + (spread[hot] % parts[at[hot]].astype(np.uint64)).astype(np.int32)
                go = np.sort(first)
                a = c.base + start[go]
                data = [raw[i:j].tobytes() for i, j in zip(a.tolist(), (a + size[go]).tolist(), strict=True)]
                cols = [bucket[go], salt[go], own[go], own_ver[go], pos[go], count[go].astype(np.int32), (anchor - start)[go].astype(np.int32), told[go]]
                yield pa.RecordBatch.from_arrays([*(pa.array(col) for col in cols), pa.array(data, pa.binary())], schema=FRAGMENTS)
                if told.any():  # runs that follow each other in one row are one
                    t = np.flatnonzero(told)
                    new = np.ones(len(t), bool)
                    new[1:] = (row[t[1:]] != row[t[:-1]]) | (start[t[1:]] != start[t[:-1]] + count[t[:-1]])
                    cut = np.flatnonzero(new)
                    n = np.add.reduceat(count[t], cut).astype(np.int32)
                    t = t[cut]
                    cols = [A.mix(own[t].view(np.uint64)).view(np.int64), np.full(len(t), -1, np.int32), own[t], own_ver[t], pos[t], n, np.zeros(len(t), np.int32), np.ones(len(t), bool)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(col) for col in cols), pa.nulls(len(t), pa.binary())], schema=FRAGMENTS)

    return run


def _spans(own, ver, pos) -> pa.RecordBatch:
    """Runs of consecutive positions of one document, settled."""
    order = np.lexsort((pos, ver, own))
    own, ver, pos = own[order], ver[order], pos[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (ver[1:] != ver[:-1]) | (pos[1:] > pos[:-1] + 1)
    cut = np.flatnonzero(new)
    end = pos[np.append(cut[1:], len(pos)) - 1] + 1
    return pa.RecordBatch.from_arrays([pa.nulls(len(cut), pa.int32()), *map(pa.array, (own[cut], ver[cut], pos[cut], end)), pa.nulls(len(cut), pa.binary())], schema=FOUND)


def _sort_rows(rows: pa.Table, open_bucket: tuple[int, int] | None, length: int, r: int, log_blocks: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeats of a block, and one occurrence of each string of buckets that are not wholly in it."""
    bucket, salt = rows["bucket"].to_numpy(), rows["salt"].to_numpy()
    first = np.ones(len(bucket), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])
    of = groups_of(first)
    partial = salt > 0
    if open_bucket:
        partial = partial | ((bucket == open_bucket[0]) & (salt == open_bucket[1]))
    use = (np.bincount(of)[of] > 1) | partial
    if not use.any():
        return
    rows, of, partial = rows.filter(pa.array(use)), of[use], partial[use]
    v, inside, _ = cover_tables(r)
    raw, offs = A.string_buffers(rows["data"])
    raw, offs = raw[offs[0] : offs[-1]], offs - offs[0]
    n, anchor, start = rows["n"].to_numpy().astype(np.int64), rows["anchor"].to_numpy() + offs[:-1], rows["start"].to_numpy()
    text = Bytes(raw)
    # a string reaches at least half of what it has beside the gram to one side of it: a bucket is split by the bytes there,
    # and strings whose half no other fragment has are alone
    half = (length - GRAM) // 2
    reach = length - GRAM - half  # starts up to here before the anchor have their half on the right
    behind = anchor - offs[:-1]
    sides = np.empty((len(n), 2), np.uint64)
    sides[:, 0] = text.prints(anchor, np.where(behind - n < reach, GRAM + half, 0))
    sides[:, 1] = text.prints(anchor - np.where(behind > reach, half, 0), np.where(behind > reach, GRAM + half, 0))
    sides = A.mix(sides + A.mix(of.astype(np.uint64) + np.uint64(1))[:, None]) ^ np.array([0, 1], np.uint64)
    have = np.stack([behind - n < reach, behind > reach], axis=1)
    _, part_of, seen = np.unique(sides[have], return_inverse=True, return_counts=True)
    part = np.full(sides.shape, -1, np.int64)
    part[have] = np.where((seen[part_of] > 1) | np.broadcast_to(partial[:, None], have.shape)[have], part_of, -1)
    frag = np.repeat(np.arange(len(n)), n)
    rel = np.arange(len(frag)) - np.repeat(np.cumsum(n) - n, n)
    group = part[frag, (behind[frag] - rel > reach).astype(np.int8)]
    live = np.flatnonzero(group >= 0)
    if not len(live):
        return
    frag, rel, group = frag[live], rel[live], group[live]
    at = offs[frag] + rel
    sample_length = length - v + 1
    used = np.flatnonzero((part >= 0).any(axis=1))
    size = np.diff(offs)[used]
    sample_of = np.repeat(used, size)
    place = np.arange(len(sample_of)) - np.repeat(np.cumsum(size) - size - offs[used], size)
    is_sample = inside[(place - anchor[sample_of]) % v] & (place + sample_length <= offs[1:][sample_of])
    samples, sample_of = place[is_sample], sample_of[is_sample]
    order, new = sort_block(text, at, anchor[frag], group, samples, of[sample_of], sample_length, length, r)
    cls = groups_of(new)
    frag, rel, at = frag[order], rel[order], at[order]
    own, ver, pos, told = rows["own"].to_numpy()[frag], rows["ver"].to_numpy()[frag], start[frag] + rel, rows["told"].to_numpy(zero_copy_only=False)[frag]
    twice = np.bincount(cls)[cls] > 1
    if len(out := np.flatnonzero(twice & ~told)):
        yield _spans(own[out], ver[out], pos[out])
    part = np.flatnonzero(new & partial[frag])
    if len(part):
        strings = np.empty(len(part), STRING)
        strings["key"], strings["told"] = A.mix(text.prints(at[part], length)), np.logical_or.reduceat(twice | told, np.flatnonzero(new))[cls[part]]
        strings["own"], strings["ver"], strings["pos"] = own[part], ver[part], pos[part]
        blk = (strings["key"] >> np.uint64(63 - log_blocks) >> np.uint64(1)).astype(np.int64)
        o = np.lexsort((frag[part], blk))
        strings, blk = strings[o], blk[o]
        cut = np.flatnonzero(np.diff(blk, prepend=-1))
        # field by field, in the order of the texts, so that shuffle files compress
        data = [b"".join(strings[f][i:j].tobytes() for f in STRING.names) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(blk)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blk[cut], pa.int32()), *(pa.nulls(len(cut), pa.int64()) for _ in range(4)), pa.array(data, pa.binary())], schema=FOUND)


def _group_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of strings, in the order of their numbers, to spans of those that two parts hold or one holds twice."""

    def settle(held: list[bytes]) -> pa.RecordBatch | None:
        fields: dict[str, list[np.ndarray]] = {f: [] for f in STRING.names}
        for data in held:
            n, at = len(data) // STRING.itemsize, 0
            for f in STRING.names:
                fields[f].append(np.frombuffer(data, STRING[f], n, at))
                at += n * STRING[f].itemsize
        key, own, ver, pos, told = (np.concatenate(fields[f]) for f in STRING.names)
        _, of, seen = np.unique(key, return_inverse=True, return_counts=True)
        out = np.flatnonzero((seen[of] > 1) & ~told)
        return _spans(own[out], ver[out], pos[out]) if len(out) else None

    held, last = [], None
    for batch in batches:
        for blk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if blk != last and held:
                if spans := settle(held):
                    yield spans
                held = []
            last = blk
            held.append(data.as_py())
    if held and (spans := settle(held)):
        yield spans


def _sort_buckets(length: int, r: int, block: int = BLOCK, log_blocks: int = 0):
    """Fragments in the order of their buckets to what they hold of repeats; holds a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, open_bucket = [], 0, None
        for batch in batches:
            known = pc.equal(batch.column("salt"), -1)
            if known.true_count:
                b = batch.filter(known)
                start, n = b.column("start").to_numpy(), b.column("n").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int32()), b.column("own"), b.column("ver"), pa.array(start), pa.array(start + n), pa.nulls(len(n), pa.binary())], schema=FOUND)
                batch = batch.filter(pc.invert(known))
            for a in range(0, batch.num_rows, 1024):
                held.append(batch.slice(a, 1024))
                size += held[-1].nbytes
                if size < block:
                    continue
                rows = pa.Table.from_batches(held)
                bucket, salt = rows["bucket"].to_numpy(), rows["salt"].to_numpy()
                last = (int(bucket[-1]), int(salt[-1]))
                whole = int(np.flatnonzero((bucket != last[0]) | (salt != last[1]))[-1]) + 1 if (bucket[0], salt[0]) != last else 0
                if whole:  # the last bucket may go on; it waits
                    yield from _sort_rows(rows.slice(0, whole).combine_chunks(), open_bucket, length, r, log_blocks)
                    open_bucket = None
                    rows = rows.slice(whole)
                if rows.nbytes >= block:
                    open_bucket = last
                    yield from _sort_rows(rows.combine_chunks(), open_bucket, length, r, log_blocks)
                    rows = rows.slice(0, 0)
                held, size = rows.to_batches(), rows.nbytes
        if held:
            yield from _sort_rows(pa.Table.from_batches(held).combine_chunks(), open_bucket, length, r, log_blocks)

    return run


def _cut(length: int, with_spans: bool):
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    names += [("kept", pa.binary()), ("span_starts", pa.list_(pa.int64())), ("span_stops", pa.list_(pa.int64()))] * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = A.string_buffers(batch.column("txt"))
            starts, stops = batch.column("starts"), batch.column("stops")
            n_removed, n_spans, sha, kept, begins, ends = [], [], [], [], [], []
            for i in range(batch.num_rows):
                data = raw[offs[i] : offs[i + 1]]
                a = b = np.zeros(0, np.int64)
                if starts[i].is_valid and len(starts[i].values):
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, starts[i].values.to_numpy(), 1)
                    np.add.at(edge, stops[i].values.to_numpy() + (length - 1), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    a, b = A.runs(gone)
                    data = data[~gone]
                n_removed.append(int((b - a).sum()))
                n_spans.append(len(a))
                left = data.tobytes()
                sha.append(hashlib.sha256(left).hexdigest())
                if with_spans:
                    kept.append(left)
                    begins.append(a)
                    ends.append(b)
            cols = [batch.column("own"), pa.array(np.diff(offs)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            cols += [pa.array(kept, pa.binary()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))] if with_spans else []
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(names))

    return run


FRAGMENT = "bucket long, salt int, own long, ver long, start long, n int, anchor int, told boolean, data binary"


def repeated_grams(texts: DataFrame, length: int, frequent: int = FREQUENT, max_log_bits: int = MAX_LOG_BITS) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, int], int]:
    """(the most frequent grams, ascending; among how many tasks each is dealt; the bitmap of all that occur twice; its log of bits), and
    the fragments of frequent grams.
    """
    counts = texts.mapInArrow(_anchors(length), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where("n > 1"), "grams")
    top = counts.where(F.col("n") > frequent).orderBy(F.desc("n"), "bucket").limit(MOST_FREQUENT).toArrow().sort_by("bucket")
    log_bits = min(max_log_bits, max(16, (4 * counts.count()).bit_length()))
    by_block = counts.repartition(F.shiftrightunsigned("bucket", 64 - max(1, log_bits - min(LOG_BLOCK, log_bits)))).select("bucket")
    bits = gather_bits(by_block.mapInArrow(_bitmap(log_bits), "blk int, bits binary"), 1, log_bits)[0]
    n = top["n"].to_numpy()
    return (top["bucket"].to_numpy(), -(-n // frequent), bits, log_bits), int(n.sum())


def repeated_spans(docs: DataFrame, length: int = LENGTH, cover_r: int = COVER_R, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """For each document with a repeated string: own, ver, starts and stops (runs of starts of repeated strings)."""
    assert length - GRAM >= cover_tables(cover_r)[0], "the cover's period must leave a sample string"
    spark = docs.sparkSession
    docs = docs.select(F.col(text_col).alias("txt"), F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("ver")).where(F.col("own").isNotNull() & (F.octet_length("txt") >= length))
    grams, n_frequent = repeated_grams(docs.select("txt"), length, frequent)
    fragments = docs.mapInArrow(_fragments(length, spark.sparkContext.broadcast(grams)), FRAGMENT)
    sorted_ = fragments.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
    log_blocks = min(20, (n_frequent * (length // 2) // STRINGS).bit_length())
    span = "blk int, own long, ver long, start long, stop long, data binary"
    found = materialise(sorted_.mapInArrow(_sort_buckets(length, cover_r, block, log_blocks), span), "repeats")
    parts = found.where("blk is not null").select("blk", "data").repartition("blk").sortWithinPartitions("blk").mapInArrow(_group_strings, span)
    spans = found.where("blk is null").unionByName(parts).select("own", "ver", "start", "stop")
    return spans.groupBy("own", "ver").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))


def dedup(docs: DataFrame, length: int = LENGTH, cover_r: int = COVER_R, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts anywhere else.

    Returns the id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left) and the removed spans.
    """
    spans = repeated_spans(docs, length, cover_r, id_col, text_col, frequent, block)
    rows = docs.select(F.col(text_col).alias("txt"), F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("ver")).join(spans, ["own", "ver"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, span_starts array<long>, span_stops array<long>" * with_spans
    return rows.select("txt", "own", "starts", "stops").mapInArrow(_cut(length, with_spans), schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_spans=False)
