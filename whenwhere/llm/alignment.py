"""Alignment of two tokenizers' ids, with corpus-wide counts of linked pairs under a minimal perfect hash.

Texts are cut into units, before a space or line feed that follows a character that is no white space: no token of either vocabulary
lies across such a place, so units are encoded on their own, and each distinct unit once while a worker remembers it. Byte offsets where
tokens of both end cut a unit into groups; the two tokens that end a group are linked.

First pass: every task counts the pairs it links. Pairs fall into slices by their second id, which bounds a slice by the vocabularies, whatever
the size of the corpus. For each slice the distinct pairs meet in a tree and get a minimal perfect hash; the tasks' counts
become dense vectors indexed by the hash (each key verified), summed in a tree; their sums lie in the shared folder, a file a slice. Second pass:
the documents are aligned again, and each unit's links are looked up in the slices' files, of which a worker holds a bounded number of bytes.
No document is shuffled; a task sends each pair at most once.

Defined results: null and empty texts, and texts whose joined token bytes differ from their own in either tokenizer, have no tokens: zeros
and an empty digest. Repeated rows are documents of their own and count; null ids are kept. Texts and units of any length are encoded whole.
An empty table gives no rows. Extra columns are ignored, or kept if ``keep`` names them; those that clash with a result's name are replaced by it.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .shared import materialise, process_cache, shared_dir
from .token_files import PATTERN, file_system
from .vocab import BYTE_OF, default_path, load_json

#: Slices of the pairs, and rows that meet in one step of a tree.
SLICES, FAN = 256, 32
#: Units, bytes of units and bytes of slices that a worker remembers; pairs that a task counts before it folds them.
KEEP_UNITS, KEEP_BYTES, SLICE_BYTES, FOLD = 300_000, 48 << 20, 192 << 20, 1 << 20
U64 = np.uint64
RESULTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SHAPE = "slice int, node int, keys binary, body binary"


# units and their alignment


def units(texts: pa.Array, cut: bool = True) -> tuple[np.ndarray, list[str], np.ndarray]:
    """A space before each text that is not empty, cut into units: their codes, the distinct units, the rows' offsets."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    raw, offs = A.string_buffers(texts)
    data, offs = raw[offs[0] : offs[-1]], offs - offs[0]
    first = np.zeros(len(data), bool)
    if cut and len(data) > 3:
        solid = data > 32
        # the last byte of a character that may be white space counts as if it were
        solid[1:] &= ~((data[1:] >= 0x80) & (data[:-1] == 0xC2))
        solid[2:] &= ~((data[2:] >= 0x80) & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
        first[1:] = ((data[1:] == 32) | (data[1:] == 10)) & solid[:-1]
    first[offs[:-1][offs[:-1] < offs[1:]]] = True
    begin = np.flatnonzero(first)
    coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(begin, offs)


class Aligner:
    """Units by number, with their links (pairs of ids as first << 32 | second); ``written`` asks for their groups in writing too."""

    def __init__(self, a_path: str, b_path: str, written: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation(), self.a.no_padding()
        spec = load_json(a_path)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [bytes(BYTE_OF[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.ranked = self._by_ranks(spec, names)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        spec = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            spec.ParseFromString(f.read())
        rule = spec.normalizer_spec
        plain = rule.name == "identity" and not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        #: Whether no piece lies across a place where units are cut; other models take whole texts.
        self.cut = plain and self.blank != self.b.unk_id() and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.written = written
        self.forget()

    def _by_ranks(self, spec: dict, names: dict[int, str]):
        """The same encoding by ranks of whole tokens, which is much faster; None where the two may differ.

        They agree if ids follow the merges and every token alone encodes to itself: a pair that is side by side when a token's turn
        comes, and spells it, is then what the token's own bytes have come to, so it is the pair of its merge.
        """
        import tiktoken

        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        rule = spec["pre_tokenizer"]
        usual = spec["normalizer"] is None and rule["type"] == "ByteLevel" and not rule["add_prefix_space"] and rule["use_regex"]
        if not usual or [names.get(256 + i) for i in range(len(merges))] != merges or any(len(names[i]) > 1 for i in range(256)):
            return None
        if any([t.id for t in self.a.model.tokenize(name)] != [i] for i, name in names.items() if i < 256 + len(merges)):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in range(256 + len(merges))}, special_tokens={}).encode_ordinary

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.n_a, self.n_b, self.size, self.begin = (np.zeros(0, np.int64) for _ in range(4))
        self.ok, self.links, self.text, self.held = np.zeros(0, bool), np.zeros(0, U64), [], 0

    @property
    def full(self) -> bool:
        return len(self.number) > KEEP_UNITS or self.held > KEEP_BYTES

    def look_up(self, names: list[str]) -> tuple[np.ndarray, int]:
        """The units' numbers, which hold until forget(), and how many are new."""
        number = self.number
        fresh = [w for w in names if w not in number]
        if fresh:
            number.update(zip(fresh, range(len(number), len(number) + len(fresh)), strict=True))
            self._add(fresh)
        return np.fromiter(map(number.__getitem__, names), np.int64, len(names)), len(fresh)

    def _encode_a(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units' numbers of ids, and the ids one after the other."""
        # Latin units may stand side by side: no pretoken lies across their seams
        quick = np.fromiter((len(w) < 500 and (w.isascii() or max(w) < "ɐ") and not w[-1].isspace() for w in names), bool, len(names)) & (self.ranked is not None and self.cut)
        slow = np.flatnonzero(~quick)
        found = [e.ids for e in self.a.encode_batch([names[i] for i in slow.tolist()], add_special_tokens=False)]
        size = np.zeros(len(names), np.int64)
        size[slow] = list(map(len, found))
        side = [names[i] for i in np.flatnonzero(quick).tolist()]
        ids = np.fromiter(chain.from_iterable(self.ranked("".join(side[i : i + 4096])) for i in range(0, len(side), 4096)), np.int64)
        stops = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in side), np.int64, len(side)))
        size[quick] = np.bincount(np.searchsorted(stops, np.cumsum(self.a_size[ids])), minlength=len(side))
        flat = np.empty(int(size.sum()), np.int64)
        of = np.repeat(quick, size)
        flat[of], flat[~of] = ids, np.fromiter(chain.from_iterable(found), np.int64)
        return size, flat

    def _encode_b(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same without the prefix that the model adds: a unit's own space takes its place, or it is dropped again."""
        spaced = [w[:1] == " " for w in names]
        found = self.b.encode([w[1:] if s else w for w, s in zip(names, spaced, strict=True)], num_threads=1)
        found = [(x or [self.blank] if len(w) == 1 else x) if s else x[1:] for w, s, x in zip(names, spaced, found, strict=True)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.int64)

    def _add(self, names: list[str]) -> None:
        (n_a, a), (n_b, b) = self._encode_a(names), self._encode_b(names)
        whole = "".join(names).encode()
        length = np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in names), np.int64, len(names))
        ok = np.ones(len(names), bool)
        if not all(b"".join(map(table.__getitem__, ids.tolist())) == whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            for table, ids, n in ((self.a_bytes, a, n_a), (self.b_bytes, b, n_b)):
                cut = np.concatenate([[0], np.cumsum(n)]).tolist()
                spelt = list(map(table.__getitem__, ids.tolist()))
                ok &= np.fromiter((b"".join(spelt[i:j]) == w.encode() for i, j, w in zip(cut[:-1], cut[1:], names, strict=True)), bool, len(names))
            a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
            n_a, n_b, length = n_a * ok, n_b * ok, length * ok
        ends, from_a, from_b = np.intersect1d(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), assume_unique=True, return_indices=True)
        # a unit that is not whole has no bytes and ends where its predecessor does: the search takes the first that ends there
        size = np.bincount(np.searchsorted(np.cumsum(length), ends), minlength=len(names))
        links = a[from_a].astype(U64) << U64(32) | b[from_b].astype(U64)
        self.begin = np.append(self.begin, len(self.links) + np.cumsum(size) - size)
        self.links = np.append(self.links, links)
        self.n_a, self.n_b, self.size, self.ok = (np.append(x, y) for x, y in ((self.n_a, n_a), (self.n_b, n_b), (self.size, size), (self.ok, ok)))
        self.held += len(whole) + 8 * len(links)
        if self.written:
            self.text += self._write(a, b, from_a, from_b, size)
            self.held += 8 * (len(a) + len(b))

    @staticmethod
    def _write(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, size: np.ndarray) -> list[str]:
        """Each unit's groups: the ids of a group's tokens, those of the first tokenizer before those of the second."""
        after_a, after_b = np.full(len(a), ","), np.full(len(b), ",")
        after_a[from_a], after_b[from_b] = "|", ";"
        # a token's place: behind all tokens of earlier groups, and the second's behind the first's
        group_a, group_b = (np.searchsorted(ends, np.arange(n)) for ends, n in ((from_a, len(a)), (from_b, len(b))))
        before_a, before_b = np.concatenate([[0], from_b + 1]), np.append(from_a + 1, len(a))
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + before_a[group_a]] = [f"{i}{c}" for i, c in zip(a.tolist(), after_a.tolist(), strict=True)]
        parts[np.arange(len(b)) + before_b[group_b]] = [f"{i}{c}" for i, c in zip(b.tolist(), after_b.tolist(), strict=True)]
        parts = parts.tolist()
        last = np.concatenate([[0], from_a + from_b + 2])[np.concatenate([[0], np.cumsum(size)])].tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip(last[:-1], last[1:], strict=True)]

    def flat(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of units one after the other, and each unit's number of them."""
        n = self.size[numbers]
        done = np.cumsum(n)
        return self.links[np.arange(int(done[-1]) if len(done) else 0) + np.repeat(self.begin[numbers] - (done - n), n)], n


@process_cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One a worker process, so that its memory outlives a task."""
    return Aligner(a_path, b_path, False)


# the minimal perfect hash


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n - 1: at each level the keys that are alone at their place stop, the others go on; a key's index is the rank of its place."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, keys: np.ndarray):
        self.words, self.sizes, self.keys = words, sizes, keys
        ones = np.bitwise_count(words).astype(np.int64)
        self.rank = (np.cumsum(ones) - ones).astype(np.uint32)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (A.mix(keys + U64((level + 1) * int(A.BASE) % 2**64)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words, sizes, left = [], [], keys
        while len(left):
            size = 64 * (2 * len(left) // 64 + 1)
            at = cls._place(left, len(sizes), size)
            lone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[lone]] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~lone]
        out = cls(np.concatenate(words or [np.zeros(0, U64)]), np.array(sizes, np.int64), np.zeros(0, U64))
        order = out._index(keys)
        out.keys = np.empty(len(keys), U64)
        out.keys[order] = keys
        return out

    def _index(self, keys: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self._place(keys[left], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            here = (word >> bit) & U64(1) > 0
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[left[here]] = self.rank[at[here] >> 6].astype(np.int64) + below[here]
            left, base = left[~here], base + size
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for keys that are not among those hashed."""
        out = self._index(keys)
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out


def slice_of(pairs: np.ndarray) -> np.ndarray:
    return (A.mix(pairs & U64(0xFFFFFFFF)) >> U64(56)).astype(np.int32)


def _save(path: str, **arrays: np.ndarray) -> None:
    """A file under its own name and then under its last: whoever repeats a task writes the same."""
    store, root = file_system(path)
    body = io.BytesIO()
    np.savez(body, **arrays)
    own = f"{root}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(body.getvalue())
    store.move(own, root)


def _load(path: str) -> dict[str, np.ndarray]:
    store, root = file_system(path)
    with store.open_input_file(root) as f:
        return dict(np.load(io.BytesIO(f.read())))


def _hash_of(folder: str, n: int) -> PerfectHash:
    return PerfectHash(**_load(f"{folder}/hash-{n:03d}"))


# first pass


def _count(a_path: str, b_path: str):
    """Rows (slice, task, pairs, counts) of the pairs that a task's documents link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        seen, parts = np.zeros(len(aligner.number), np.int64), []

        def fold() -> None:
            used = np.flatnonzero(seen)
            links, n = aligner.flat(used)
            parts.append((links, np.repeat(seen[used], n)))
            if sum(len(p[0]) for p in parts) > FOLD or len(parts) > 64:
                parts[:] = [_sum_pairs(parts)]

        for batch in batches:
            for r, e in A.row_chunks(A.string_buffers(batch.column(0))[1]):
                codes, names, ends = units(batch.column(0)[r:e], aligner.cut)
                if aligner.full:
                    fold()
                    aligner.forget()
                    seen = np.zeros(0, np.int64)
                numbers, _ = aligner.look_up(names)
                seen = np.append(seen, np.zeros(len(aligner.size) - len(seen), np.int64))
                flat = numbers[codes]
                bad = np.flatnonzero(~aligner.ok[flat])
                if len(bad):  # one unit that differs takes its document with it
                    row = np.repeat(np.arange(e - r), np.diff(ends))
                    flat = flat[~np.isin(row, row[bad])]
                seen += np.bincount(flat, minlength=len(seen))
        fold()
        pairs, counts = _sum_pairs(parts)
        of = slice_of(pairs)
        order = np.lexsort((pairs, of))
        pairs, counts, of = pairs[order], counts[order], of[order]
        task = TaskContext.get().partitionId()
        for n in np.unique(of).tolist():
            i, j = np.searchsorted(of, [n, n + 1])
            yield _row(n, task, pairs[i:j], counts[i:j])

    return run


def _sum_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, of, np.concatenate([p[1] for p in parts]))
    return pairs, counts


def _row(n: int, node: int, keys: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([node], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([body.tobytes()], pa.binary())], names=["slice", "node", "keys", "body"])


def _fold_rows(start, add, end):
    """Folds the neighbouring rows of each (slice, node): ``state = start(slice)``, ``state = add(state, keys, body)``, ``end(slice, state)`` gives (keys, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for n, node, keys, body in zip(*(batch.column(c) for c in range(4)), strict=True):
                if at != (n.as_py(), node.as_py()):
                    if at:
                        yield _row(*at, *end(at[0], state))
                    at = n.as_py(), node.as_py()
                    state = start(at[0])
                state = add(state, np.frombuffer(keys.as_buffer(), U64), np.frombuffer(body.as_buffer(), np.int64))
        if at:
            yield _row(*at, *end(at[0], state))

    return run


def _tree(rows: DataFrame, n_nodes: int, steps) -> DataFrame:
    """Folds the nodes of each slice, FAN at a time, until one is left; ``steps(first, last)`` gives the fold of a level."""
    first = True
    while True:
        n_nodes = -(-n_nodes // FAN)
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).repartition("slice", "node").sortWithinPartitions("slice", "node")
        rows = rows.mapInArrow(steps(first, n_nodes <= 1), SHAPE)
        if n_nodes <= 1:
            return rows
        first = False


def _hash_steps(folder: str):
    """Distinct pairs meet; the last level hashes them and writes the hash."""
    none = np.zeros(0, np.int64)

    def end(n: int, keys: np.ndarray):
        built = PerfectHash.build(keys)
        _save(f"{folder}/hash-{n:03d}", words=built.words, sizes=built.sizes, keys=built.keys)
        return none, np.array([len(keys)])

    return lambda first, last: _fold_rows(lambda n: np.zeros(0, U64), lambda s, keys, body: np.union1d(s, keys), end if last else lambda n, s: (s, none))


def _count_steps(folder: str):
    """Dense vectors indexed by the hash; the first level fills them from counted pairs, the last writes them with each pair's standing."""

    def start(n: int):
        return _hash_of(folder, n), []

    def fill(state, keys: np.ndarray, body: np.ndarray):
        hashed, vector = state
        if not vector:
            vector.append(np.zeros(len(hashed.keys), np.int64))
        at = hashed.index(keys)
        if (at < 0).any():
            raise KeyError("a pair is not among those hashed: the documents changed between two reads")
        vector[0][at] += body  # a row has each pair once
        return state

    def add(state, keys: np.ndarray, body: np.ndarray):
        hashed, vector = state
        if vector:
            vector[0] += body
        else:
            vector.append(body.copy())
        return state

    def write(n: int, state):
        hashed, (counts,) = state
        seconds, of = np.unique(hashed.keys & U64(0xFFFFFFFF), return_inverse=True)
        top = np.zeros(len(seconds), np.int64)
        np.maximum.at(top, of, counts)
        _save(f"{folder}/counts-{n:03d}", counts=counts, best=counts == top[of])
        return np.zeros(0, U64), np.array([counts.sum()])

    return lambda first, last: _fold_rows(start, fill if first else add, write if last else lambda n, s: (np.zeros(0, U64), s[1][0]))


def count_links(docs: DataFrame, a_path: str, b_path: str) -> str:
    """Counts the linked pairs of all documents (column text); the folder that has them."""
    folder = f"{shared_dir(docs.sparkSession)}/pairs-{uuid.uuid4().hex}"
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    parts = materialise(docs.mapInArrow(_count(a_path, b_path), SHAPE), "links")
    n_nodes = (parts.agg(F.max("node")).first()[0] or 0) + 1
    _tree(parts, n_nodes, _hash_steps(folder)).write.format("noop").mode("overwrite").save()
    _tree(parts, n_nodes, _count_steps(folder)).write.format("noop").mode("overwrite").save()
    return folder


# second pass


class Counts:
    """Counts of pairs from the slices' files; slices that were not used for longest leave when there are too many bytes."""

    def __init__(self, folder: str):
        self.folder, self.held, self.bytes = folder, OrderedDict(), 0

    def _slice(self, n: int) -> tuple[PerfectHash, np.ndarray, np.ndarray, int]:
        if n in self.held:
            self.held.move_to_end(n)
            return self.held[n]
        hashed, found = _hash_of(self.folder, n), _load(f"{self.folder}/counts-{n:03d}")
        size = sum(x.nbytes for x in (hashed.words, hashed.rank, hashed.keys, *found.values()))
        while self.held and self.bytes + size > SLICE_BYTES:
            self.bytes -= self.held.popitem(last=False)[1][3]
        self.held[n] = hashed, found["counts"], found["best"], size
        self.bytes += size
        return self.held[n]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        of = slice_of(pairs)
        order = np.argsort(of, kind="stable")
        cut = np.flatnonzero(np.diff(of[order], prepend=-1))
        for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
            hashed, counted, tops, _ = self._slice(int(of[order[i]]))
            at = hashed.index(pairs[order[i:j]])
            if (at < 0).any():
                raise KeyError("a pair is not among those counted: the documents changed between two reads")
            counts[order[i:j]], best[order[i:j]] = counted[at], tops[at]
        return counts, best


class Looked:
    """Units with the sums over their links: of the counts, and of links that are their second id's most frequent."""

    def __init__(self, a_path: str, b_path: str, folder: str):
        self.units, self.counts = Aligner(a_path, b_path, True), Counts(folder)
        self.total, self.n_best = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, names: list[str]) -> np.ndarray:
        if self.units.full:
            self.units.forget()
            self.total, self.n_best = self.total[:0], self.n_best[:0]
        numbers, fresh = self.units.look_up(names)
        if fresh:
            links, n = self.units.flat(np.arange(len(self.total), len(self.units.size)))
            counts, best = self.counts.look_up(links)
            of = np.concatenate([[0], np.cumsum(n)])
            self.total, self.n_best = np.append(self.total, _by_row(counts, of)), np.append(self.n_best, _by_row(best.astype(np.int64), of))
        return numbers


@process_cache
def _looked(a_path: str, b_path: str, folder: str) -> Looked:
    return Looked(a_path, b_path, folder)


def _by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


def _align(a_path: str, b_path: str, folder: str, keep: list[str]):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in RESULTS[1:7]), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = _looked(a_path, b_path, folder)
        aligner = looked.units
        for batch in batches:
            text, columns = batch.column("_text"), [[] for _ in range(7)]
            for r, e in A.row_chunks(A.string_buffers(text)[1]):
                codes, names, ends = units(text[r:e], aligner.cut)
                flat = looked.look_up(names)[codes]
                whole = (_by_row((~aligner.ok[flat]).astype(np.int64), ends) == 0) & (np.diff(ends) > 0)
                for column, values in zip(columns, (aligner.n_a, aligner.n_b, aligner.size, aligner.size, looked.n_best, looked.total), strict=False):
                    column.append(np.where(whole, _by_row(values[flat], ends), 0))
                written, of = aligner.text, flat.tolist()
                for i, j, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), whole.tolist(), strict=True):
                    columns[6].append(hashlib.sha256(";".join([written[u] for u in of[i:j]]).encode()).hexdigest() if ok else "")
            arrays = [batch.column("_id"), *(pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns[:6]), pa.array(columns[6], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(f"_keep_{c}") for c in keep], names=[*schema.names, *keep])

    return run


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: its tokens, groups and links, and how often the corpus links the same pairs."""
    a_path, b_path = a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model")
    keep = [c for c in keep if c not in RESULTS]
    folder = count_links(docs.select(F.col(text_col).cast("string").alias("_text")), a_path, b_path)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_align(a_path, b_path, folder, keep), ", ".join(f"{c} long" for c in RESULTS[:7]) + ", groups_sha256 string" + kinds)


def op11(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
