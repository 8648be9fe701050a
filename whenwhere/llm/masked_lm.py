"""Documents scored by masked pseudo-likelihood under a bidirectional window network, trained in numpy.

Words are counted over the whole corpus. The most frequent ones (as many as the corpus's distinct words call for) are tokens of their own, all
others fall on hashed tokens. Tokens are dealt to classes by frequency, of about equal mass and at most CLASS_TOKENS tokens. The network
sees the tokens of the three words on each side, each as a learnt vector gated by its place and as a row of its class by place, and predicts
the masked token by a two-step softmax, both steps learnt: log P(token | both sides) = log P(class | h) + log P(token | class, h), with h its hidden layer. A word on a hashed token has the token's
probability times the word's own share of it, from a table of the tail's counts that grows with the corpus. A document's score is the sum over
all its words.

Training is one pass over every document: each task starts from the same weights, masks a quarter of the words (by a hash of text
and place) and takes Adam steps for the classes and Adagrad steps for the tokens' vectors and within classes; the tasks' weights are averaged by the number of words they
masked, in two levels of partial sums. Training again after the loss of an executor sees the same rows and masks the same words.

Defined results: a text without words (null, empty) has no tokens, a score of 0 and a null mean. Rows with null or repeated
doc_id are scored like any other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .shared import materialise

HASHED, MASS_CLASSES, CLASS_TOKENS, SIDE, HIDDEN = 64, 64, 256, 3, 24
#: Words of their own: one in WORDS_SHARE distinct words, within these bounds. The tail's counts: up to 2**MAX_LOG_TAIL slots, two a distinct word.
LEAST_WORDS, MOST_WORDS, WORDS_SHARE, MAX_LOG_TAIL, LOG_TAIL_BLOCK = 8192, 65_536, 256, 24, 16
MASK_ONE_IN, BATCH, RATE, WITHIN_BATCH, WITHIN_RATE, VECTOR_RATE = 4, 1024, 0.01, 16_384, 0.1, 0.05
PART_FLOATS, SALTS, SCORED = 65_536, 64, 32_768


@dataclass
class Vocabulary:
    """Tokens: the frequent words' hashes in ascending order, then the hashed rest; by token its class, place and log share in it."""

    hashes: np.ndarray
    cls: np.ndarray
    log_share: np.ndarray
    log_mass: np.ndarray  # of each class
    members: list[np.ndarray]  # the tokens of each class
    place: np.ndarray  # of a token among its class's
    tail: np.ndarray  # counts of the words on hashed tokens, by slot
    hashed_mass: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.log_mass)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return np.where(known, at, len(self.hashes) + (hashes % np.uint64(HASHED)).astype(np.int64))

    def tail_share(self, hashes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The log share of words in their hashed tokens; 0 for words of their own. A word never counted has that of one seen once."""
        out = np.zeros(len(hashes))
        at = np.flatnonzero(tokens >= len(self.hashes))
        slot = (hashes[at] >> np.uint64(64 - (len(self.tail).bit_length() - 1))).astype(np.int64)
        out[at] = np.log(np.maximum(self.tail[slot], 1) / self.hashed_mass[tokens[at] - len(self.hashes)])
        return np.minimum(out, 0)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = []
        _, offs = A.string_buffers(batch.column(0))
        for r0, r1 in A.row_chunks(offs):
            codes, words, _ = A.split_words(batch.column(0).slice(r0, r1 - r0))
            if len(codes):
                held.append((A.hash_strings(words), np.bincount(codes, minlength=len(words))))
        if held:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(u.view(np.int64)), "n": pa.array(np.bincount(at, weights=n).astype(np.int64))})


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): the count of each word's hash over all texts."""
    return texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _tail_blocks(log_tail: int):
    """(blk, data): the counts of the words of a block of slots, as 32-bit numbers."""
    log_block = min(LOG_TAIL_BLOCK, log_tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - log_tail)).astype(np.int64)
            n = batch.column(1).to_numpy()
            for blk in np.unique(slot >> log_block).tolist():
                mine = slot >> log_block == blk
                np.add.at(held.setdefault(blk, np.zeros(1 << log_block, np.int64)), slot[mine] & ((1 << log_block) - 1), n[mine])
        for blk, counts in held.items():
            yield pa.RecordBatch.from_pydict({"blk": pa.array([blk], pa.int32()), "data": pa.array([np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    return run


def build_vocabulary(counts: DataFrame, size: int | None = None) -> Vocabulary:
    distinct = counts.count()
    size = size or min(MOST_WORDS, max(LEAST_WORDS, distinct // WORDS_SHARE))
    top = counts.orderBy(F.desc("n"), "word").limit(size).toArrow()
    hashes, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(np.float64)
    # the low six bits of the hash as an unsigned number name the hashed token
    rest = {r["b"]: r["n"] for r in counts.groupBy(F.col("word").bitwiseAND(HASHED - 1).alias("b")).agg(F.sum("n").alias("n")).collect()}
    left = np.array([rest.get(b, 0) for b in range(HASHED)], np.float64)
    np.subtract.at(left, (hashes % np.uint64(HASHED)).astype(np.int64), n)
    log_tail = min(MAX_LOG_TAIL, max(10, (2 * distinct).bit_length()))
    tail = np.zeros(1 << log_tail, np.uint32)
    if distinct > len(hashes):
        rare = counts.where(F.col("n") <= float(n.min())).select("word", "n")
        blocks = rare.repartition(F.shiftrightunsigned("word", 64 - max(1, log_tail - LOG_TAIL_BLOCK))).mapInArrow(_tail_blocks(log_tail), "blk int, data binary")
        for r in blocks.toLocalIterator():
            part = np.frombuffer(r["data"], np.uint32)
            tail[r["blk"] * len(part) : (r["blk"] + 1) * len(part)] += part
    order = np.argsort(hashes)
    hashes, mass = hashes[order], np.concatenate([n[order], left]) + 1.0
    rank = np.argsort(-mass, kind="stable")
    # greedy bins: a class closes when it has its share of what was left when it opened, or is full
    cls, c, got, held, share, rem = np.zeros(len(mass), np.int64), 0, 0.0, 0, mass.sum() / MASS_CLASSES, mass.sum()
    for t in rank:
        if got >= share or held == CLASS_TOKENS:
            c, rem, got, held = c + 1, rem - got, 0.0, 0
            share = rem / max(1, MASS_CLASSES - c)
        cls[t] = c
        got += mass[t]
        held += 1
    total = np.bincount(cls, weights=mass)
    by_class = np.argsort(cls, kind="stable")
    members = np.split(by_class, np.cumsum(np.bincount(cls))[:-1])
    place = np.empty(len(cls), np.int64)
    for m in members:
        place[m] = np.arange(len(m))
    return Vocabulary(hashes, cls, np.log(mass / total[cls]), np.log(total / mass.sum()), members, place, tail, left + 1.0)


@dataclass
class Weights:
    """The network: rows of classes by place, hidden bias, classes and their bias, gates by place; vectors of the sides' tokens; tokens within classes and their bias."""

    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    gates: np.ndarray
    vectors: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return list(vars(self).values())

    def dense(self) -> list[np.ndarray]:
        """What every step changes."""
        return [self.hidden, self.bias, self.out, self.out_bias, self.gates]

    def copy(self) -> Weights:
        return Weights(*(p.copy() for p in self.arrays()))


def start_weights(vocabulary: Vocabulary, seed: int = 1) -> Weights:
    """A network that knows the tokens' shares and nothing of the sides."""
    rng, c, n = np.random.default_rng(seed), vocabulary.classes, len(vocabulary.cls)
    hidden, out, gates = rng.normal(0, 0.3, (2 * SIDE * (c + 1), HIDDEN)), rng.normal(0, 0.02, (HIDDEN, c)), rng.normal(1, 0.3, (2 * SIDE, HIDDEN))
    w = (hidden, np.zeros(HIDDEN), out, vocabulary.log_mass, gates, np.zeros((n + 1, HIDDEN)), np.zeros((n, HIDDEN)), vocabulary.log_share)
    return Weights(*(x.astype(np.float32) for x in w))


def contexts(tokens: np.ndarray, ends: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """For the words ``at`` the tokens on both sides; documents do not see each other, what lies outside is a token of its own."""
    row = np.searchsorted(ends, at, side="right") - 1
    row_start, row_end = ends[row], ends[row + 1]
    out = np.empty((len(at), 2 * SIDE), np.int32, order="F")
    for j, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        p = at + shift
        out[:, j] = np.where((p >= row_start) & (p < row_end), tokens[np.clip(p, 0, len(tokens) - 1)], outside)
    return out


def rows_of(vocabulary: Vocabulary, sides: np.ndarray) -> np.ndarray:
    """The rows of the sides' classes, by place."""
    cls = np.append(vocabulary.cls, vocabulary.classes).astype(np.int32)
    return cls[sides] + np.arange(sides.shape[1], dtype=np.int32) * (vocabulary.classes + 1)


def by_place(vocabulary: Vocabulary, w: Weights) -> list[np.ndarray]:
    """What a token on either side adds to the hidden layer: a table for each place, for weights that stay."""
    rows = rows_of(vocabulary, np.repeat(np.arange(len(w.vectors))[:, None], 2 * SIDE, axis=1))
    return [w.hidden[rows[:, j]] + w.vectors * w.gates[j] for j in range(2 * SIDE)]


def hidden_layer(w: Weights, tables: list[np.ndarray], sides: np.ndarray) -> np.ndarray:
    h = np.tile(w.bias, (len(sides), 1))
    for j, table in enumerate(tables):
        h += np.take(table, sides[:, j], axis=0)
    return np.tanh(h, out=h)


def softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def log_chance(z: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax at one place of each row."""
    z -= z.max(axis=1, keepdims=True)
    there = z[np.arange(len(z)), of]
    np.exp(z, out=z)
    return there - np.log(z.sum(axis=1))


def _sums(at: np.ndarray, values) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in ``at``, ascending, and the sums of their values; ``values`` gives those of an order."""
    order = np.argsort(at, kind="stable")
    cut = np.flatnonzero(np.diff(at[order], prepend=-1))
    return at[order[cut]], np.add.reduceat(values(order), cut, axis=0)


class Adam:
    """Steps on the classes of masked words; the sides' vectors take Adagrad steps, as each step meets few of them."""

    def __init__(self, w: Weights, rate: float = RATE):
        self.w, self.rate, self.t = w, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in w.dense()], [np.zeros_like(p) for p in w.dense()]
        self.seen = np.full_like(w.vectors, 1e-3)

    def step(self, sides: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Learns the classes ``y``; returns the hidden layer."""
        w, n, places = self.w, len(y), rows.shape[1]
        beside = [np.take(w.vectors, sides[:, j], axis=0) for j in range(places)]
        h = np.tile(w.bias, (n, 1))
        for j, v in enumerate(beside):
            h += np.take(w.hidden, rows[:, j], axis=0)
            h += v * w.gates[j]
        np.tanh(h, out=h)
        d = softmax(h @ w.out + w.out_bias)
        d[np.arange(n), y] -= 1
        d /= n
        back = (d @ w.out.T) * (1 - h * h)
        g_hidden = np.zeros_like(w.hidden)
        met, g_hidden_met = _sums(rows.T.reshape(-1), lambda o: np.take(back, o % n, axis=0))
        g_hidden[met] = g_hidden_met
        g_gates = np.stack([np.einsum("ij,ij->j", back, v) for v in beside])
        gated = (back * w.gates[:, None]).reshape(-1, HIDDEN)  # by place, then word
        met, g_vectors = _sums(sides.T.reshape(-1), lambda o: np.take(gated, o, axis=0))
        g_vectors *= np.float32(np.sqrt(n))
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) / (1 + self.t / 2000)
        for p, m, v, g in zip(w.dense(), self.m, self.v, (g_hidden, back.sum(axis=0), h.T @ d, d.sum(axis=0), g_gates), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= np.float32(rate) * m / (np.sqrt(v) + 1e-8)
        self.seen[met] += g_vectors * g_vectors
        w.vectors[met] -= np.float32(VECTOR_RATE) * g_vectors / np.sqrt(self.seen[met])
        return h


def by_class(cls: np.ndarray):
    """(class, places) of the classes that occur."""
    order = np.argsort(cls, kind="stable")
    at = np.flatnonzero(np.diff(cls[order], prepend=-1))
    yield from ((int(cls[order[a]]), order[a:b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True))


class Within:
    """Adagrad over the tokens within each class."""

    def __init__(self, w: Weights, vocabulary: Vocabulary):
        self.u, self.b, self.vocabulary = w.inner, w.inner_bias, vocabulary
        self.gu, self.gb = np.full_like(w.inner, 1e-3), np.full_like(w.inner_bias, 1e-3)

    def step(self, h: np.ndarray, tokens: np.ndarray) -> None:
        for c, at in by_class(self.vocabulary.cls[tokens]):
            m = self.vocabulary.members[c]
            if len(m) == 1:
                continue
            x = h[at]
            d = softmax(x @ self.u[m].T + self.b[m])
            d[np.arange(len(at)), self.vocabulary.place[tokens[at]]] -= 1
            d /= np.sqrt(len(at))
            for p, g, now in ((self.u, self.gu, d.T @ x), (self.b, self.gb, d.sum(axis=0))):
                g[m] += now * now
                p[m] -= np.float32(WITHIN_RATE) * now / np.sqrt(g[m])


def _classes_of(texts: pa.Array, vocabulary: Vocabulary):
    codes, words, ends = A.split_words(texts)
    if not len(codes):
        return np.zeros(0, np.int64), ends, np.zeros(0, np.uint64)
    hashes = A.hash_strings(words)
    return vocabulary.tokens(hashes)[codes], ends, hashes[codes]


def _train(shared, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        weights = weights.copy()  # other tasks of this worker start from the same ones
        model, within, seen = Adam(weights), Within(weights, vocabulary), 0
        for batch in batches:
            _, offs = A.string_buffers(batch.column(0))
            for r0, r1 in A.row_chunks(offs):
                tokens, ends, hashes = _classes_of(batch.column(0).slice(r0, r1 - r0), vocabulary)
                if not len(tokens):
                    continue
                cls = vocabulary.cls[tokens]
                masked = np.flatnonzero(A.mix(hashes + np.arange(len(hashes), dtype=np.uint64)) % np.uint64(one_in) == 0)
                masked = masked[np.argsort(A.mix(masked.astype(np.uint64) + hashes[masked]))]
                sides, y = contexts(tokens, ends, masked, len(vocabulary.cls)), cls[masked]
                rows = rows_of(vocabulary, sides)
                for a in range(0, len(y), WITHIN_BATCH):
                    stop = min(len(y), a + WITHIN_BATCH)
                    h = [model.step(*(v[i : min(stop, i + BATCH)] for v in (sides, rows, y))) for i in range(a, stop, BATCH)]
                    within.step(np.concatenate(h), tokens[masked[a:stop]])
                seen += len(y)
        if seen:
            flat = np.concatenate([p.ravel() for p in weights.arrays()]).astype(np.float64) * seen
            for part, a in enumerate(range(0, len(flat), PART_FLOATS)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), pa.array([flat[a : a + PART_FLOATS].tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["part", "salt", "x", "n"])

    return run


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part: the sum of its vectors and of their words."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, _, x, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = held.setdefault(part, [0.0, 0])
            at[0], at[1] = at[0] + np.frombuffer(x), at[1] + n
    for part, (x, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["part", "salt", "x", "n"])


def train(texts: DataFrame, vocabulary: Vocabulary, weights: Weights | None = None, one_in: int = MASK_ONE_IN) -> Weights:
    """The tasks' weights averaged by their words; one pass over all texts."""
    weights = weights or start_weights(vocabulary)
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, weights))
    schema = "part int, salt int, x binary, n long"
    summed = texts.mapInArrow(_train(shared, one_in), schema).repartition("part", "salt").mapInArrow(_sum_parts, schema).repartition("part").mapInArrow(_sum_parts, schema)
    parts = sorted((r["part"], np.frombuffer(r["x"]) / r["n"]) for r in summed.toLocalIterator())
    if not parts:
        return weights
    cut = np.cumsum([p.size for p in weights.arrays()])[:-1]
    return Weights(*(a.reshape(p.shape).astype(np.float32) for a, p in zip(np.split(np.concatenate([x for _, x in parts]), cut), weights.arrays(), strict=True)))


def log_probabilities(vocabulary: Vocabulary, w: Weights, tables: list[np.ndarray], tokens: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """log P(word | both sides) of every word of a chunk of texts."""
    cls = vocabulary.cls[tokens]
    out = vocabulary.tail_share(hashes, tokens)
    for a in range(0, len(tokens), SCORED):
        at = np.arange(a, min(len(tokens), a + SCORED))
        at = at[np.argsort(cls[at], kind="stable")]  # the words of a class side by side
        h = hidden_layer(w, tables, contexts(tokens, ends, at, len(vocabulary.cls)))
        of = cls[at]
        got = log_chance(h @ w.out + w.out_bias, of)
        cut = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            m = vocabulary.members[of[i]]
            if len(m) > 1:
                got[i:j] += log_chance(h[i:j] @ w.inner[m].T + w.inner_bias[m], vocabulary.place[tokens[at[i:j]]])
        out[at] += got
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, w = shared.value
        tables = by_place(vocabulary, w)
        for batch in batches:
            _, offs = A.string_buffers(batch.column(1))
            for r0, r1 in A.row_chunks(offs):
                tokens, ends, hashes = _classes_of(batch.column(1).slice(r0, r1 - r0), vocabulary)
                total = np.concatenate([[0.0], np.cumsum(log_probabilities(vocabulary, w, tables, tokens, ends, hashes))])
                n, score = np.diff(ends), total[ends[1:]] - total[ends[:-1]]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(r0, r1 - r0), "n_tokens": pa.array(n), "pll": pa.array(score), "mean_pll": pa.array(score / np.maximum(n, 1), mask=n == 0)})

    return run


def score(docs: DataFrame, vocabulary: Vocabulary, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, pll (sum of the conditional log-probabilities) and its mean."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), "doc_id long, n_tokens long, pll double, mean_pll double")


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, Weights]:
    """Counts, vocabulary and network from all texts."""
    texts = docs.select(F.col(text_col).alias("text"))
    vocabulary = build_vocabulary(materialise(count_words(texts), "words"))
    return vocabulary, train(texts, vocabulary)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document's score under the network trained on all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, *fit(docs))
