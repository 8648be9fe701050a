"""Benchmark decontamination by one Aho-Corasick automaton over the benchmark's normalised windows.

Texts are normalised byte for byte (A-Z to a-z, every byte that is in no word to a space), so a place in the normalised text is
the place in the original. Words are numbered by the benchmark's vocabulary; a number is spelt in a few digits, each place with its own
alphabet, so that no node of the automaton has many children and a match can only begin where a word begins. The automaton holds all
windows of all items and reads each text once; between words that no item has it starts anew, so runs of known words shorter than
the shortest window are not read.

An automaton holds at most ``max_windows`` (window, item) pairs, which bounds what is broadcast. A larger benchmark is dealt by hash
into several; the documents pass them one after the other and carry the hits found so far. Nothing is shuffled but the benchmark.

Defined results: null and empty texts have no words; an item without words has no window; an item of fewer words than a window is one
window. Rows of the benchmark that share an id are one item; a row with a null id marks words but is not named. Repeated documents and null ids are judged each by
its own text. An empty benchmark hits nothing, an empty table gives no rows. Extra columns are ignored, or kept if ``keep`` names them; those
that clash with a result's name are replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .shared import materialise, process_cache

WINDOW, MAX_WINDOWS = 10, 1 << 18
#: Letters of a digit's alphabet, and the letter of a word that no item has.
DIGITS, UNKNOWN = 60, 255
NORMAL = np.full(256, 32, np.uint8)
NORMAL[48:58], NORMAL[97:123], NORMAL[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
NORMAL[65:91] = NORMAL[97:123]
RESULTS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised words, the rows' offsets into them, and each word's first byte and end in its row's text."""
    raw, offs = A.string_buffers(texts)
    data = NORMAL[raw[offs[0] : offs[-1]]]
    offs = offs - offs[0]
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offs[:-1][(offs[:-1] < len(data)) & (offs[:-1] < offs[1:])]
    first[edge] = inside[edge]
    begin = np.flatnonzero(first)
    seen = np.concatenate([[0], np.cumsum(inside)])
    at = np.append(seen[begin], seen[-1]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside])))
    ends = np.searchsorted(begin, offs)
    row_start = np.repeat(offs[:-1], np.diff(ends))
    return words, ends, begin - row_start, begin - row_start + np.diff(at)


def item_windows(rows: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): the normalised words of each window, joined by spaces, and the item's id as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall((text or "").translate(LOWER))
                n = min(window, len(words))
                # one text's windows at a time
                found = list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))) if n else []
                if found:
                    yield pa.RecordBatch.from_pydict({"window": pa.array(found), "item": pa.array([item] * len(found), pa.string())})

    return rows.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "window string, item string").distinct()


class Matcher:
    """The automaton over some windows, their lengths and items."""

    def __init__(self, pairs: pa.Table):
        coded = pairs.column("window").combine_chunks().dictionary_encode()
        windows = [w.split(" ") for w in coded.dictionary.to_pylist()]
        self.vocabulary = pa.array(sorted({x for w in windows for x in w}), pa.large_string())
        self.size = np.fromiter(map(len, windows), np.int64, len(windows))
        self.digits = 1
        while DIGITS**self.digits < len(self.vocabulary):
            self.digits += 1
        number = {x: n for n, x in enumerate(self.vocabulary.to_pylist())}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, w in enumerate(windows):
            self.automaton.add_word(self.spell(np.array([number[x] for x in w])), n)
        self.automaton.make_automaton()
        # the items of window n are items[begin[n]:begin[n + 1]]
        of = coded.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        self.begin = np.searchsorted(of[order], np.arange(len(windows) + 1))
        named = pairs.column("item").combine_chunks().dictionary_encode()
        self.names = named.dictionary.to_pylist()
        self.items = pc.fill_null(named.indices, -1).to_numpy(zero_copy_only=False)[order]

    def spell(self, numbers: np.ndarray) -> str:
        """Each number in digits, the k-th from an alphabet of its own; -1 in the letter of unknown words."""
        out = np.empty((len(numbers), self.digits), np.uint8)
        for k in range(self.digits):
            out[:, k] = np.where(numbers < 0, UNKNOWN, numbers // DIGITS**k % DIGITS + k * DIGITS)
        return out.tobytes().decode("latin-1")

    def find(self, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, window) of every occurrence of a window in one row."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.size) or not len(words):
            return none
        number = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = number >= 0
        # runs of known words in one row, then those that have room for a window
        cut = known.copy()
        cut[1:] &= ~known[:-1]
        edge = ends[:-1][ends[:-1] < len(number)]
        cut[edge] = known[edge]
        begin = np.flatnonzero(cut)
        if not len(begin):
            return none
        size = np.diff(np.append(np.cumsum(known)[begin] - 1, int(known.sum())))
        begin, size = begin[size >= self.size.min()], size[size >= self.size.min()]
        if not len(begin):
            return none
        stop = np.cumsum(size + 1)  # a word that no item has after each run
        at = np.arange(int(stop[-1])) + np.repeat(begin - (stop - size - 1), size + 1)
        spelt = number[np.minimum(at, len(number) - 1)]
        spelt[stop - 1] = -1
        met = np.array(list(self.automaton.iter(self.spell(spelt))), np.int64).reshape(-1, 2)
        return at[met[:, 0] // self.digits], met[:, 1]


@process_cache
def _matcher(pairs: Broadcast) -> Matcher:
    """One automaton a worker process."""
    return Matcher(pa.ipc.open_stream(pairs.value).read_all())


def _rows_of(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, at, side="right") - 1


def _hits(matcher: Matcher, words: pa.Array, ends: np.ndarray, hit: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """The maximal runs of hit words (first, end, row), with those found earlier, and the rows' items."""
    n_rows = len(ends) - 1
    last, window = matcher.find(words, ends)
    mark = np.zeros(len(words) + 1, np.int32)
    for row, old in enumerate(hit):
        if old:
            spans = np.frombuffer(old, np.int64).reshape(-1, 2) + ends[row]
            np.add.at(mark, spans[:, 0], 1)
            np.add.at(mark, spans[:, 1], -1)
    np.add.at(mark, last + 1 - matcher.size[window], 1)
    np.add.at(mark, last + 1, -1)
    a, b = _runs_in_rows(np.cumsum(mark[:-1]) > 0, ends[:-1][ends[:-1] < len(words)])
    # each window once a row, then its items
    once = np.unique(np.stack([_rows_of(ends, last), window], axis=1), axis=0)
    n = matcher.begin[once[:, 1] + 1] - matcher.begin[once[:, 1]]
    done = np.cumsum(n)
    item = matcher.items[np.arange(int(done[-1]) if len(done) else 0) + np.repeat(matcher.begin[once[:, 1]] - (done - n), n)]
    pair = np.unique(np.stack([np.repeat(once[:, 0], n), item], axis=1), axis=0)
    pair = pair[pair[:, 1] >= 0]
    cut = np.searchsorted(pair[:, 0], np.arange(n_rows + 1)).tolist()
    names = [matcher.names[x] for x in pair[:, 1].tolist()]
    return a, b, _rows_of(ends, a), [names[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _pass(pairs: Broadcast):
    """Adds the hits of one automaton: ``_hit`` has the hit words as runs (first, end), ``_items`` the items' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(pairs)
        for batch in batches:
            text, hit, named = (batch.column(n) for n in ("_text", "_hit", "_items"))
            hits, items = [], []
            for r, e in A.row_chunks(A.string_buffers(text)[1]):
                words, ends, _, _ = words_of(text[r:e])
                a, b, row, new = _hits(matcher, words, ends, hit[r:e].to_pylist())
                span = np.stack([a - ends[row], b - ends[row]], axis=1)
                cut = np.searchsorted(row, np.arange(e - r + 1)).tolist()
                hits += [span[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                items += [[*(old or ()), *x] for old, x in zip(named[r:e].to_pylist(), new, strict=True)]
            out = batch.set_column(batch.schema.get_field_index("_hit"), "_hit", pa.array(hits, pa.binary()))
            yield out.set_column(batch.schema.get_field_index("_items"), "_items", pa.array(items, pa.list_(pa.string())))

    return run


def _runs_in_rows(flags: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, parted where a row begins."""
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    first[row_starts] = flags[row_starts]
    last[:-1] &= ~flags[1:]
    before = row_starts[row_starts > 0] - 1
    last[before] = flags[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _last_pass(pairs: Broadcast, keep: list[str]):
    """The last automaton, and the results."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", span)])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(pairs)
        for batch in batches:
            text = batch.column("_text")
            raw, offs = A.string_buffers(text)
            n_words, n_hit, items, spans = [], [], [], []
            for r, e in A.row_chunks(offs):
                words, ends, begin, stop = words_of(text[r:e])
                a, b, row, new = _hits(matcher, words, ends, batch.column("_hit")[r:e].to_pylist())
                n_words += np.diff(ends).tolist()
                n_hit += np.bincount(row, weights=b - a, minlength=e - r).astype(np.int64).tolist()
                items += [sorted({*(old or ()), *x}) for old, x in zip(batch.column("_items")[r:e].to_pylist(), new, strict=True)]
                cut = np.searchsorted(row, np.arange(e - r + 1)).tolist()
                for n, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    places = []
                    if i < j:  # bytes to code points: count what is no continuation byte
                        point = np.concatenate([[0], np.cumsum((raw[offs[r + n] : offs[r + n + 1]] & 0xC0) != 0x80)])
                        places = [{"start": x, "end": y} for x, y in zip(point[begin[a[i:j]]].tolist(), point[stop[b[i:j] - 1]].tolist(), strict=True)]
                    spans.append(places)
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in items]
            columns = [batch.column("_id"), n_words, n_hit, [len(x) for x in items], digests, [n > 0 for n in n_hit], items, spans]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(f"_keep_{f}") for f in keep], names=[*schema.names, *keep])

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids) and spans.

    ``spans`` are the maximal runs of hit words as (start, end) in code points of the original text.
    """
    spark = docs.sparkSession
    pairs = materialise(item_windows(benchmark, window=window), "windows")
    passes = max(1, -(-pairs.count() // max_windows))
    keep = [c for c in keep if c not in RESULTS]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    rows = rows.withColumn("_hit", F.lit(None).cast("binary")).withColumn("_items", F.lit(None).cast("array<string>"))
    schema = rows.schema
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out_schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:bigint,end:bigint>>" + kinds
    for p in range(passes):
        table = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == p).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        part = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        if p + 1 == passes:
            return rows.mapInArrow(_last_pass(part, keep), out_schema)
        rows = materialise(rows.mapInArrow(_pass(part), schema), "hits")


def op13(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document against every item of the benchmark."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find(docs, items).select(*RESULTS[:6])


SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct cast(item_id as varchar) as item, n, array_to_string(w[k:k + n - 1], ' ') as win
  from (select item_id, w, least({WINDOW}, len(w)) as n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as k from i where len(w) > 0)),
dw as (select rid, n, k, array_to_string(w[k:k + n - 1], ' ') as win
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from iw) where len(w) >= n)),
m as (select rid, k, dw.n, item from dw join iw on dw.n = iw.n and dw.win = iw.win),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + n)) as p from m) group by rid),
t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from m where item is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)
"""
