"""The dealt operators with a contract, against brute force on small tables with odd rows."""

import hashlib
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from whenwhere.llm import ann, bpe, packing, probminhash, quality, substring_dedup, suffix_dedup, suffix_sort

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, ver string, kept string, own string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "clash", "clash", "clash", "clash") for i, t, s in rows], SCHEMA)


def corpus(seed=3):
    """Passages that are shared, exact and near copies, repeated rows, odd white space, a very long text, nulls and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = make(70)
    rows = [(i, make(rng.randrange(5, 120)) + ("\n" + shared + " " if i % 3 == 0 else ""), f"s{i % 3}") for i in range(40)]
    base = make(150)
    near = base.split(" ")
    rows += [(50, base, "s0"), (51, base, "s1"), (52, " ".join([*near[:70], "new", *near[71:]]), "s0"), (53, base.upper(), "s0"), (54, None, "s0"), (55, "", None), (56, "  \t\n ", "s1"), (57, "one", "s1"), (58, "a b c d", "s1"), (60, "\x1c\x85 x y", "s2")]
    rows += [(61, make(9000) + " " + shared, "s2"), (62, "x" * 5000, "s2"), (63, "ab " * 900, "s2")]
    rows += [(50, base, "s0"), (58, "a b c d", "s1")]  # repeated rows
    rows += [(None, shared, "s0")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def by_row(got, *cols):
    return Counter(tuple(r[c] for c in cols) for r in got)


@pytest.mark.parametrize("log_width", [28, 8])
def test_op1(spark, rows, log_width):
    got = substring_dedup.dedup(table(spark, rows), max_log_width=log_width, keep=("lang",)).collect()
    first = {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    want = Counter()
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == want
    assert {r["lang"] for r in got} == {"en"}


@pytest.mark.parametrize(("cover", "frequent", "block"), [(2, 1000, 4 << 20), (1, 2, 4 << 20), (2, 1000, 1), (2, 5, 5000)])
def test_op3(spark, rows, cover, frequent, block):
    got = suffix_dedup.dedup(table(spark, rows), cover_r=cover, frequent=frequent, block=block).collect()
    seen = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        if i is not None:
            seen.update(b[j : j + 400] for j in range(len(b) - 399))
    want = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if i is not None and seen[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()] += 1
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(bytes(r["kept"]) is not None and len(r["span_starts"]) == r["n_spans"] for r in got)


def test_passages_round_a_chunk_edge(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    rng, log_width = random.Random(6), 20
    text = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passages = [text(400) for _ in range(420)]
    long = [text(1199 - d) + "K" + p + "L" + text(2400 + d) for d, p in enumerate(passages)]  # edges at 1000, 2000, 3000
    texts = [*long, *(text(49) + "M" + p + "N" + text(49) for p in passages)]
    batch = pa.RecordBatch.from_pydict({"txt": texts, "own": pa.array(range(len(texts)), pa.int64()), "ver": pa.array([0] * len(texts), pa.int64())})
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(1 << 13, 255, np.uint8), 16)
    rows = pa.Table.from_batches(suffix_dedup._fragments(400, SimpleNamespace(value=none))([batch])).sort_by([("bucket", "ascending"), ("salt", "ascending")])
    got = {(r["own"], r["start"], r["stop"]) for b in suffix_dedup._sort_buckets(400, 2)(rows.to_batches()) for r in b.to_pylist()}
    assert got == {(d, 1200 - d, 1201 - d) for d in range(420)} | {(420 + d, 50, 51) for d in range(420)}


def test_repeats_of_a_text_of_many_chunks(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    edge, part = 2 << 20, text(700)
    long = text(edge - 150) + part + text(edge) + text(2 << 20)
    got = suffix_dedup.dedup(spark.createDataFrame([(1, long), (2, text(30) + part + text(30)), (3, text(900))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"] // 10, r["n_spans"]) for r in got} == {1: (70, 1), 2: (70, 1), 3: (0, 0)}


@pytest.mark.parametrize("r", [1, 2])
def test_block_is_in_lexicographic_order(r):
    """Few letters, periods and near copies, so that ties are long and meet at all distances; distinct anchors within a bucket."""
    rng = random.Random(r)
    v, inside, _ = suffix_sort.cover_tables(r)
    length = v + 60
    base = "".join(rng.choices("ab", k=900))
    texts = ["a" * 1200, "ab" * 600, base, base[:500] + "c" + base[500:], base[7:], "a" * 300 + base, base[200:] + "ab" * 200]
    raw, offs = b"".join(t.encode() for t in texts), np.cumsum([0, *map(len, texts)])
    frag = np.repeat(np.arange(len(texts)), np.diff(offs))
    place = np.arange(len(raw))
    anchor = offs[:-1] + np.array([rng.randrange(500) for _ in texts])
    bucket = frag // 3
    at = place[place + length <= offs[1:][frag]]
    samples = place[inside[(place - anchor[frag]) % v] & (place + length - v + 1 <= offs[1:][frag])]
    order, new = suffix_sort.sort_block(suffix_sort.Bytes(np.frombuffer(raw, np.uint8)), at, anchor[frag[at]], bucket[at], samples, bucket[samples], length - v + 1, length, r)
    got = [(bucket[p], raw[p : p + length]) for p in at[order].tolist()]
    assert got == sorted(got)
    assert new.tolist() == [True] + [a != b for a, b in zip(got, got[1:])]


@pytest.mark.parametrize("r", [1, 2, 3])
def test_cover_meets_every_difference(r):
    v, d = suffix_sort.difference_cover(r)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_op5(spark, rows):
    got = probminhash.classes(table(spark, rows)).collect()
    sets = defaultdict(list)
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        if i is not None:
            sets[i].append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter())

    def alike(a, b):
        if not a or not b:
            return False
        plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
        weighted = sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())
        return max(plain, weighted) >= 0.8 - 1e-9

    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(alike(a, b) for a in sets[i] for b in sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i in ids} | {None: None}
    assert len(got) == len(rows)


def test_probability_jaccard_is_estimated():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(1, 2**63, 300, dtype=np.uint64))
    wa, wb = rng.integers(1, 5, 250), rng.integers(1, 5, 250)
    sig = probminhash.signatures(np.repeat([0, 1], 250), np.concatenate([keys[:250], keys[50:]]), np.concatenate([wa, wb]).astype(float), 2, 4096)
    exact, _ = probminhash.similarity(keys[:250], wa, keys[50:], wb)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_near_copies_of_a_large_group_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(base[:p] + [f"x{i}"] + base[p + 1 :]), "s") for i in range(700) for p in [rng.randrange(200)]] + [(900, "some other words stand here", "s")]
    got = probminhash.classes(table(spark, rows)).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 900} == {0}
    assert {r["class_id"] for r in got if r["doc_id"] == 900} == {900}


def test_copies_whose_passages_repeat_differently_share_a_class(spark):
    rng = random.Random(9)
    rows = []
    for i in range(0, 80, 2):
        w = [f"r{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(i, " ".join(w), "s"), (i + 1, " ".join(w[:60] + w[60:90] * 10 + w[90:]), "s")]  # plain Jaccard 146 / 150
    rows += [(i + 100, t + " end" * (1 + i % 3), s) for i, t, s in rows if i % 2]  # these repeat alike
    got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(table(spark, rows)).collect()}
    assert got == {i: i % 100 // 2 * 2 for i in got} and len(got) == 120


def test_op6(spark, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [*rows, (70, "İstanbul ΣΑΣ don't <|endoftext|>x ½ 12 é \xa0y 中文 z" * 30, "s")]
    got = packing.pack(table(spark, odd)).collect()
    want = Counter(zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t, _ in odd)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert len(r["ids"]) == r["length"] > 0
    padding = tokens = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    ordered = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    whole, held = Counter(), []
    for r in ordered:
        if r["start"] == 0:
            held = []
        assert r["start"] == len(held)
        held += r["ids"]
        if len(held) == r["doc_tokens"]:
            whole[zlib.crc32(np.array(held, "<u4").tobytes())] += 1
    assert whole == want
    assert padding <= 2048 * 8 + 0.02 * tokens


def test_cuts_are_the_best_ones():
    rng = np.random.default_rng(1)
    for _ in range(30):
        b = np.unique(np.concatenate([[0], rng.integers(1, 900, 25)]))
        cost = rng.integers(0, 50, len(b))
        if (np.diff(b) > 128).any():
            continue
        pad = lambda n: 0 if n in (32, 64, 128) else 128 - n
        f = [0] + [10**9] * (len(b) - 1)
        for j in range(1, len(b)):
            f[j] = min(f[i] + (cost[i] if i else 0) + pad(b[j] - b[i]) + packing.WINDOW_COST for i in range(j) if b[j] - b[i] <= 128)
        got = packing.cuts(b, np.where(np.arange(len(b)) == 0, 0, cost), 128)
        at = np.searchsorted(b, got)
        total = sum((cost[i] if i else 0) + pad(b[j] - b[i]) + packing.WINDOW_COST for i, j in zip(at, at[1:], strict=False))
        assert total == f[-1]


def packed(monkeypatch, batches):
    """What one packing task gives for lists of (doc_id, text)."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    made = (pa.RecordBatch.from_arrays([pa.array([i for i, _ in b], pa.int64()), pa.array([t for _, t in b], pa.string())], ["doc_id", "text"]) for b in batches)
    return packing._pack(public_tokenizers.path("word_bpe_49k.json"), 2048, 1, True)(made)


@pytest.mark.parametrize("size", [1, 300, 40_000])
def test_sequences_run_on_over_parts_and_batches(monkeypatch, size):
    """Every batch used to end in a padded sequence."""
    monkeypatch.setattr(packing, "TOKENISED_BYTES", size, raising=False)
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 2, raising=False)
    rng = random.Random(size)
    text = lambda n: " ".join(rng.choice(["word", "end.", "Ωmega", "x" * rng.randrange(1, 9), "\n"]) for _ in range(n))
    docs = [(i if i % 7 else None, None if i % 11 == 5 else text(rng.choice([0, 1, 30, 400, 3000]))) for i in range(150)] + [(500, "9" * 30_000), (501, text(30_000)), (502, "")]
    got = [r for b in packed(monkeypatch, [docs[i : i + 3] for i in range(0, len(docs), 3)]) for r in b.to_pylist()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in docs]
    left, ends = iter(got), {}
    for i, ids in want:  # in the order of the rows
        at = 0
        while at < len(ids):
            r = next(left)
            n = r["length"]
            assert (r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) == (i, at, len(ids), ids[at : at + n]) and n > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + n
            at += n
    assert next(left, None) is None and sorted(ends) == list(range(3 << 36, (3 << 36) + len(ends))) and max(ends.values()) <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in ends.values()) <= 2048 + 0.02 * sum(ends.values())


def test_a_packing_task_holds_a_part_of_a_batch(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" + "." * (i % 15 == 0) for i in range(3000)]
    batch = [(i, " ".join(rng.choices(words, k=700))) for i in range(4000)]
    peaks = []
    for n in (len(batch) // 4, len(batch)):
        rows = [batch[:n]]
        tracemalloc.start()
        assert sum(sum(b.column(2).to_pylist()) for b in packed(monkeypatch, rows)) > n * 700
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 20, peaks


def test_words_are_hashed_a_part_of_a_batch_at_a_time():
    rng = random.Random(5)
    texts = pa.array([" ".join(f"{rng.randrange(36**5):06d}" for _ in range(500)) for _ in range(1100)])  # some 4 MB
    list(substring_dedup._batch_windows(texts[:10], 13))
    tracemalloc.start()
    n = sum(len(keys) for keys, _, _ in substring_dedup._batch_windows(texts, 13))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == 1100 * 488 and peak < 60, peak


def test_dropped_caches_give_memory_back():
    code = """
import re
from whenwhere.llm import shared
held = lambda: sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024
kept = []
@shared.process_cache
def words():
    out = []
    for i in range(400_000):  # what stays lies between what goes, as in a worker
        out.append(("%09d" % i) * 60)
        kept.append(b"x" * 600) if i % 2000 == 0 else None
    return out
words()
before = held()
shared.drop_caches()
print(before, held())
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    before, after = map(float, subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.split())
    assert after < 0.4 * before, (before, after)


@pytest.mark.parametrize("keep_first", [False, True])
def test_op7(spark, rows, keep_first):
    odd = [*rows, *((100 + i, "same line here 2024\n" + " ".join(f"u{i}x{j}" for j in range(60)), "h") for i in range(12)), (120, "same  LINE here 1999\n" * 3 + "tail", "h"), (121, "#a #b $ <|> word\nword\n\nword", None)]
    got = quality.apply_rules(table(spark, odd), min_docs=4, share=0.1, keep_first=keep_first, keep=("text", "lang")).collect()
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower()))
    hosts, lines, firsts = Counter(), defaultdict(set), {}
    for i, t, s in odd:
        hosts[s] += 1
        for x in {norm(x) for x in (t or "").split("\n") if WORD.search(x)}:
            lines[s, x].add(t)
            if i is not None:
                firsts[s, x] = min(i, firsts.get((s, x), i))
    want = Counter()
    for i, t, s in odd:
        x = t or ""
        w = WORD.findall(x)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {j + k for j, z in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[z] > 1 for k in range(3)}
        ls = [z for z in x.split("\n") if WORD.search(z)]
        bad = lambda z: bool(WORD.search(z)) and len(lines[s, norm(z)]) > max(4, 0.1 * hosts[s]) and (not keep_first or i is None or firsts[s, norm(z)] != i)  # noqa: E731, B023
        gone = sum(len(WORD.findall(z)) for z in ls if bad(z))
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        kept_text = None if t is None else "\n".join(z for z in x.split("\n") if not bad(z))
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(ls) - len(set(ls)), len(rep), failed, not failed and len(w) - gone >= 0.3 * len(w), gone, kept_text, "en"] += 1
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words", "kept_text", "lang") == want


def test_op8(spark, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "é", "中", "😀", "<|endoftext|>", "'s", "'ll", "1", "22", "_", "...", "aaaa", "the", "ing", "́", "\r\n", "ab" * 30]
    odd = [*rows, *((200 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))), "s") for i in range(300))]
    got = bpe.encode(table(spark, odd), digest=True).collect()
    want = Counter()
    for i, t, _ in odd:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode(bpe.encode(table(spark, rows))).collect()
    assert Counter(r["text"] for r in back) == Counter(t or "" for _, t, _ in rows)


def test_op9(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 24)).astype(np.float32)
    x[100] = x[200]
    x[300] = 0
    vecs = [(int(i), [float(v) for v in x[i]]) for i in range(500)]
    vecs[10] = (10, None)
    vecs[11] = (11, [float("nan"), *vecs[11][1][1:]])
    vecs[12] = (12, [None, *vecs[12][1][1:]])
    vecs[13] = (13, [float("inf"), *vecs[13][1][1:]])
    vecs[14] = (14, [1.0, 2.0])
    vecs += [vecs[20], (None, vecs[21][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<float>, score int").repartition(5)
    got = ann.search(df.where("vec_id % 100 = 0"), df).collect()
    good = {i: np.array(v, np.float64) for i, v in vecs if i is not None and i not in (10, 11, 12, 13, 14, 300)}
    want = set()
    for q in (0, 100, 200, 400):
        near = sorted((float(np.sqrt(np.cumsum((good[q] - v) ** 2)[-1])), i) for i, v in good.items() if i != q)[:10]
        want |= {(q, n + 1, i, s) for n, (s, i) in enumerate(near)}
    assert {tuple(r) for r in got} == want
    cells = ann.search(df.where("vec_id % 100 = 0"), df, strip_bytes=2 * 24 * 8, part_bytes=60 * 24 * 8)  # a grid of two strips and nine parts
    assert {tuple(r) for r in cells.collect()} == want
    few = df.where("vec_id < 4")
    assert ann.search(few.where("vec_id = 0"), few).count() == 3
    assert ann.search(few.where("vec_id = 99"), few).count() == 0


def test_a_hot_id_leaves_room_for_the_others():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 8))
    ids = np.concatenate([np.arange(1, 151), np.full(50, 7)])
    x[150:] = 0.01 * x[150:]  # fifty rows of id 7 round the query
    q = ann.Tile(np.array([0]), np.full((1, 8), 1e-3))
    at, to, score = ann.nearest(q, ann.Tile(ids, x), 10)
    _, vec, _ = ann._best(q.ids[at], ids[to], score, 10)
    exact = np.sqrt(((x - 1e-3) ** 2).sum(axis=1))
    least = {i: exact[ids == i].min() for i in set(ids.tolist())}
    assert vec.tolist() == sorted(least, key=least.get)[:10]


def test_a_heap_bounds_later_blocks():
    rng = np.random.default_rng(9)
    q = ann.Tile(np.array([3, 5]), rng.normal(size=(2, 8)))
    near, far = ann.Tile(np.arange(100, 140), q.x[0] + 0.1 * rng.normal(size=(40, 8))), ann.Tile(np.arange(200, 260), 50 + rng.normal(size=(60, 8)))
    at, to, score = ann.nearest(q, near, 10)
    held = ann._best(q.ids[at], near.ids[to], score, 10)
    reach = ann._reach(q.ids, held, 10)
    assert reach.tolist() == [held[2][9], held[2][19]]
    assert len(ann.nearest(q, far, 10, reach)[0]) == 0 < len(ann.nearest(q, far, 10)[0])
    some = tuple(x[:13] for x in held)  # the second query holds three
    assert ann._reach(q.ids, some, 10).tolist() == [held[2][9], np.inf]


def test_int8_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = (ann.Tile(np.arange(40), rng.normal(size=(40, 33)) * rng.uniform(1e-3, 1e3, (40, 1))) for _ in range(2))
    exact = np.sqrt(((a.x[:, None] - b.x[None]) ** 2).sum(axis=2))
    slack = a.error[:, None] + b.error + 1e-7 * (np.sqrt(a.norm)[:, None] + np.sqrt(b.norm))
    assert (np.abs(a.approximate(b) - exact) <= slack).all()


@pytest.mark.parametrize("f", [substring_dedup.dedup, suffix_dedup.dedup, probminhash.classes, packing.pack, quality.apply_rules, bpe.encode])
def test_empty_table(spark, f):
    assert f(table(spark, [])).count() == 0
