"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

A pretoken's encoding is found without merging: an automaton over the vocabulary lists the tokens that end at each place,
longest first (its suffix links); a token may be the last of a prefix exactly if the tokens before it end in one that it is
compatible with, that is, if merging the two tokens' bytes side by side gives the two back. Exactly one token passes at each
place. Following these last tokens back from the end gives the ids.

Two neighbours are compatible if no merge across their seam would have come before the merges that made them. That is
tested by unmaking, step by step, whichever side was made last.

Defined results: a null or empty text has no ids and decodes to the empty text. Repeated rows and rows with a null id are
encoded like any other. Texts of any length are encoded whole, in linear time. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .vocab import BYTE_OF, BYTE_PATTERN, SPACE, default_path, load_json

KEEP = 800_000


class Bpe:
    """The vocabulary by rank: bytes are ranks 0 to 255, the token that merge i makes is rank 256 + i."""

    def __init__(self, path: str):
        spec = load_json(path)
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        single = sorted(BYTE_OF, key=BYTE_OF.get)
        names = [*single, *(a + b for a, b in merges)]
        rank = {n: r for r, n in enumerate(names)}
        self.id_of = [ids[n] for n in names]
        self.halves = [(r, r) for r in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.made = {pair: 256 + i for i, pair in enumerate(self.halves[256:])}
        spelt = [bytes(BYTE_OF[c] for c in n) for n in names]
        self.size = list(map(len, spelt))
        self.automaton = ahocorasick.Automaton()
        for r, b in enumerate(spelt):
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {self.id_of[r]: b for r, b in enumerate(spelt)} | {i: t.encode() for t, i in self.special.items()}
        self.seams: dict[int, bool] = {}  # compatible pairs and others, by left << 32 | right

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge over the seam precedes the merges that close it; ``before`` is the rank that closes the seam's sides last."""
        before = 1 << 60
        while True:
            if self.made.get((left, right), before) < before:
                return False
            # unmake the side made later: ranks are merge order, and of equal sides the left was made first
            if left > right:
                before, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
                if right < 256:
                    return True
                before, right = right + 1, self.halves[right][0]
            else:
                inner = self.halves[right][0]
                if inner != right:
                    before, right = right + 1, inner
                    continue
                if left < 256:
                    return True
                before, left = left, self.halves[left][1]

    def pretoken(self, data: bytes) -> list[int]:
        """The ids of one pretoken."""
        last: list[int] = [-1] * len(data)  # the last token of each prefix
        size, seams = self.size, self.seams
        if len(seams) > 1_000_000:
            seams.clear()
        for end, r in self.automaton.iter(data.decode("latin-1")):
            if last[end] < 0:
                start = end - size[r]
                if start < 0:
                    last[end] = r
                elif (left := last[start]) >= 0:
                    fits = seams.get(left << 32 | r)
                    if fits is None:
                        fits = seams[left << 32 | r] = self.compatible(left, r)
                    if fits:
                        last[end] = r
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(self.id_of[last[at]])
            at -= size[last[at]]
        return out[::-1]


class Memo(dict):
    """Remembers a function's results for short keys; of the older half only what is used again stays."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep // 2, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) < 64:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Encoder:
    """Texts to little-endian 32-bit ids; remembers chunks (white space and the word after it) and pretokens."""

    def __init__(self, path: str, keep: int = KEEP):
        self.bpe = Bpe(path)
        self.pattern = regex.compile(BYTE_PATTERN)
        self.chunk = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.bpe.special)) + ")")
        self.pretokens = Memo(lambda p: self.bpe.pretoken(p.encode("utf-8", "surrogatepass")), keep)
        self.chunks = Memo(self._chunk, keep)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for p in self.pattern.findall(chunk):
            ids += self.pretokens[p]
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.chunk.findall(text)))

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.bpe.special):
            return self._plain(text)
        return b"".join(np.array([self.bpe.special[part]], "<u4").tobytes() if part in self.bpe.special else self._plain(part) for part in self.cut.split(text))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _encode(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            _, offs = A.string_buffers(batch.column(1))
            for r0, r1 in A.row_chunks(offs):
                ids = [encoder.encode(t or "") for t in batch.column(1).slice(r0, r1 - r0).to_pylist()]
                cols = {"doc_id": batch.column(0).slice(r0, r1 - r0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if digest:
                    back = (encoder.decode(np.frombuffer(x, "<u4")) for x in ids)
                    cols["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back], pa.string())
                else:
                    cols["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return run


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens and the ids, or with ``digest`` the hashes of the ids and of their decoding."""
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_encode(vocabulary or default_path("byte_bpe_50k.json"), digest), schema)


def decode(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of the ids; special tokens are kept as their text, a null list gives a null text."""
    return tokens.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(_decode(vocabulary or default_path("byte_bpe_50k.json")), "doc_id long, text string")


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
