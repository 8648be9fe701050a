"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the multiset of its 5-word shingles, weighted by their counts. Each shingle is a Poisson process of that rate
whose arrivals fall on random registers; a register keeps the shingle of its first arrival, so two documents agree in a
register with the probability Jaccard similarity. Arrivals later than all registers' times end a process early. A document
in which shingles repeat is signed again with all counts 1, so that it also meets those that are alike as plain sets; where
no shingle repeats the two signatures are one.

32 bands of 6 registers of each signature give the candidates: at a similarity of 0.8 a pair shares no band once in 17,000 times.
Within a band's bucket an 8-bit form of the registers is compared, in blocks of bounded size; pairs that agree in fewer than 65 %
in both signatures are left out (five standard deviations under 0.8). A spanning forest of each block's pairs suffices to find which documents hang
together at all. These components of candidates then meet with their shingles, again in blocks, and every two of them that agree
in 65 % are verified unless verified links connect them already. So neither step emits the pairs of a group, and no
link between classes is lost. Exact copies are one node throughout. Components, of candidates and of links, are found by
large-star and small-star steps.

Two documents are linked if their exact probability Jaccard, or its unweighted form, is at least the threshold.

Defined results: a text without words (null, empty, blank) is a class of its own; one of under 5 words has one shingle, all
its words. Exact copies share a class. The class id is the least doc_id in the class. A null doc_id takes no part and has a null
class. Rows that share a doc_id are one document, linked if any of its texts is. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .shared import drop_caches, materialise

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
LEAST_AGREEMENT, BLOCK = 0.65, 256
_STEP, _REG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle fingerprint, count), ascending by row and fingerprint."""
    codes, words, ends = A.split_words(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = A.hash_strings(words)[codes]
    keys, at = A.word_windows(hashes, ends, k)
    lens = np.diff(ends)
    row = np.repeat(np.arange(len(lens)), lens)[at]
    short = np.flatnonzero((lens > 0) & (lens < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            on = lens[short] > j
            whole[on] = whole[on] * A.WORD_BASE + hashes[ends[short[on]] + j]
        row, keys = np.concatenate([row, short]), np.concatenate([keys, A.mix(whole + np.uint64(k))])
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])])[: len(row)])
    return row[new], keys[new], np.diff(np.append(new, len(row)))


def signatures(row: np.ndarray, keys: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """n_rows x m registers; a row without shingles has zeros."""
    times = np.full(n_rows * m, np.inf)
    owner = np.zeros(n_rows * m, np.uint64)
    live, t = np.arange(len(row)), np.zeros(len(row))
    last = np.full(n_rows, np.inf)
    step = 0
    while len(live):
        step += 1
        with np.errstate(over="ignore"):
            draw = A.mix(keys[live] + _STEP * np.uint64(step))
            slot = row[live] * m + ((A.mix(draw ^ _REG) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[live]
        early = t < times[slot]
        s, x = slot[early], t[early]
        np.minimum.at(times, s, x)
        won = times[s] == x
        owner[s[won]] = keys[live[early][won]]
        if step % 4 == 1 or len(live) < 5000:
            last = times.reshape(n_rows, m).max(axis=1)
        on = t < last[row[live]]
        live, t = live[on], t[on]
    return owner.reshape(n_rows, m)


def _sign(k: int, bands: int, rows: int):
    m = bands * rows

    def banded(sig):
        acc = np.zeros((len(sig), bands), np.uint64)
        for j in range(rows):
            acc = acc * A.WORD_BASE + sig[:, j::rows]
        return A.mix(acc + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            _, offs = A.string_buffers(batch.column(2))
            for r0, r1 in A.row_chunks(offs, 1 << 20):
                row, keys, count = shingles(batch.column(2).slice(r0, r1 - r0), k)
                has = np.unique(row)
                if not len(has):
                    continue
                place = np.searchsorted(has, row)
                sig = signatures(place, keys, count.astype(np.float64), len(has), m)
                twice = np.zeros(len(has), bool)
                twice[place[count > 1]] = True
                on = twice[place]
                again = signatures((np.cumsum(twice) - 1)[place[on]], keys[on], np.ones(int(on.sum())), int(twice.sum()), m)
                at = np.concatenate([[0], np.cumsum(bands * (1 + twice))])
                band = np.empty(at[-1], np.int64)
                band[at[:-1, None] + np.arange(bands)] = banded(sig)
                band[at[:-1][twice, None] + bands + np.arange(bands)] = banded(again)
                small = [x.tobytes() for x in (A.mix(sig) >> np.uint64(56)).astype(np.uint8)]
                for i, x in zip(np.flatnonzero(twice).tolist(), (A.mix(again) >> np.uint64(56)).astype(np.uint8), strict=True):
                    small[i] += x.tobytes()
                pick = pa.array(has + r0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(band)), pa.array(small, pa.binary())],
                    ["doc_id", "copy", "bands", "small"],
                )

    return run


def _agreement(small: tuple[bytes, ...], m: int) -> np.ndarray:
    """Registers in which each two of the rows agree, in the signature where they agree better; a row of m bytes has one for both."""
    first = np.frombuffer(b"".join(x[:m] for x in small), np.uint8).reshape(-1, m)
    out = np.zeros((len(small), len(small)), np.int16)
    for sig in (first, np.frombuffer(b"".join(x[-m:] for x in small), np.uint8).reshape(-1, m))[: 1 + any(len(x) > m for x in small)]:
        for a in range(0, len(sig), 64):
            np.maximum(out[a : a + 64], (sig[a : a + 64, None, :] == sig[None, :, :]).sum(axis=2), out=out[a : a + 64], casting="unsafe")
    return out


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of greatest agreement over pairs with close > 0 (Prim)."""
    n = len(close)
    out, best, via = [], np.zeros(n, close.dtype), np.zeros(n, np.int64)
    todo = np.ones(n, bool)
    while todo.any():
        score = np.where(todo, best, -1)
        i = int(score.argmax())
        if best[i] > 0:
            out.append((int(via[i]), i))
        todo[i] = False
        better = todo & (close[i] > best)
        best[better], via[better] = close[i][better], i
    return out


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int):
    """Rows of sorted batches by their first ``n_keys`` columns, each group's other columns as lists."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if len(held) > 1:
                    yield list(zip(*held, strict=True))
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if len(held) > 1:
        yield list(zip(*held, strict=True))


def _told(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Pairs as batches, each pair once a batch."""
    out: set[tuple[int, int]] = set()
    for a, b in found:
        out.add((min(a, b), max(a, b)))
        if len(out) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=EDGES)
            out = set()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=EDGES)


def _bucket_forest(m: int, least: float):
    """A spanning forest over the pairs of each block that agree enough; sorted input: bucket, block pair, node, small."""

    def found(batches):
        for ids, small in _groups(batches, 3):
            if len(ids) == 2:  # most blocks
                if ids[0] != ids[1] and any((np.frombuffer(small[0][x], np.uint8) == np.frombuffer(small[1][x], np.uint8)).sum() >= least * m for x in (slice(m), slice(-m, None))):
                    yield ids
                continue
            num = np.array(ids)
            close = _agreement(small, m)
            close[(close < least * m) | (num[:, None] == num)] = 0
            for i, j in _forest(close):
                yield ids[i], ids[j]

    return lambda batches: _told(found(batches))


def _verified_links(m: int, least: float, threshold: float):
    """Links that connect each block's classes; sorted input: candidate component, block pair, node, small, keys, counts."""

    def found(batches):
        for ids, small, keys, counts in _groups(batches, 3):
            n = len(ids)
            close = _agreement(small, m)
            i, j = np.nonzero(np.triu(close >= least * m, 1))
            best_first = np.argsort(-close[i, j], kind="stable")
            sets = [(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int32)) for k, c in zip(keys, counts, strict=True)]
            root = list(range(n))

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(i[best_first].tolist(), j[best_first].tolist(), strict=True):
                x, y = find(a), find(b)
                if x != y and linked(sets[a], sets[b], threshold):
                    root[x] = y
                    yield ids[a], ids[b]

    return lambda batches: _told(found(batches))


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = A.string_buffers(batch.column(1))
            for r0, r1 in A.row_chunks(offs):
                row, keys, count = shingles(batch.column(1).slice(r0, r1 - r0), k)
                cut = np.searchsorted(row, np.arange(r1 - r0 + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(r0, r1 - r0), pa.array([keys[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([count[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())],
                    ["node", "keys", "counts"],
                )

    return run


def similarity(ka: np.ndarray, ca: np.ndarray, kb: np.ndarray, cb: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard of two weighted sets, and plain Jaccard; keys ascend."""
    both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / (len(ka) + len(kb) - len(both))
    if ca.max() == 1 and cb.max() == 1:
        return plain, plain
    only_a, only_b = ca.sum() - ca[i].sum(), cb.sum() - cb[j].sum()
    x, y = ca[i].astype(np.float64), cb[j].astype(np.float64)
    pairs, n = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    total = 0.0
    for (p, q), times in zip(pairs.T, n, strict=True):
        total += times / (np.maximum(x / p, y / q).sum() + only_a / p + only_b / q)
    return total, plain


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    return max(similarity(*a, *b)) >= threshold - 1e-9


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node of its component."""
    now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        now = materialise(small.where("u <> v").distinct(), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, node, p, q): a group of over two blocks' size is cut into blocks by node, and every two blocks meet as one (p, q)."""
    rows = rows.join(sizes, "group").withColumn("nb", F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    met = rows.select("group", "node", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    return met.select("group", "node", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"))


def classes(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id of every row."""
    m = bands * rows
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("copy"), F.col(text_col).alias("txt"))
    known = docs.where("doc_id is not null and txt is not null")
    signed = known.mapInArrow(_sign(k, bands, rows), "doc_id long, copy binary, bands array<long>, small binary")
    nodes = materialise(signed.groupBy("copy").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("small").alias("small")), "nodes")

    banded = nodes.select("node", F.explode(F.array_distinct("bands")).alias("group"))
    member = _dealt(banded, banded.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")).join(nodes.select("node", "small"), "node")
    dealt = member.select("group", "p", "q", "node", "small").repartition("group", "p", "q").sortWithinPartitions("group", "p", "q")
    hang = components(dealt.mapInArrow(_bucket_forest(m, LEAST_AGREEMENT), "a long, b long"))

    held = materialise(hang.unionByName(hang.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "group"), "candidates")
    # by merge at every size: the plan of a large corpus is the plan of a small one
    texts = known.select("doc_id", "txt").join(held.select("node").hint("merge"), F.col("doc_id") == F.col("node"), "left_semi").distinct()
    sets = texts.mapInArrow(_shingle_rows(k), "node long, keys binary, counts binary")
    member = _dealt(held, held.groupBy("group").agg(F.count("*").alias("n"))).join(nodes.select("node", "small").hint("merge"), "node").join(sets, "node")
    dealt = member.select("group", "p", "q", "node", "small", "keys", "counts").repartition("group", "p", "q").sortWithinPartitions("group", "p", "q")
    roots = components(dealt.mapInArrow(_verified_links(m, LEAST_AGREEMENT, threshold), "a long, b long"))
    named = nodes.select("copy", "node").join(roots, "node", "left").select("copy", F.coalesce("root", "node").alias("root"))
    out = docs.select("doc_id", "copy").join(named, "copy", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("class_id"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document's class."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
