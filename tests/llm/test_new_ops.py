"""Codes of vectors, decontamination and alignment of tokenizers, against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from whenwhere.llm import decontamination, vector_codes

SCHEMA = "doc_id long, text string, lang string, n_words string, items string, _text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# decontamination


def contaminated_corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "ß9", "日本", "x"]
    make = lambda n, by=" ": by.join(rng.choice(words) for _ in range(n))
    items = [(f"i{n}", make(rng.randrange(1, 25))) for n in range(1, 30)]
    items += [("i7", make(12)), ("i1", None), ("none", ""), ("marks", "?! ..."), (None, make(11)), ("short", "w1 W2"), ("one", "Qq"), ("same", items[3][1]), ("b10", items[3][1].upper()), ("é,", make(10))]
    docs = [(n, make(rng.randrange(0, 60), rng.choice([" ", "\n", " -- ", "... "])) + " " + rng.choice(items)[1].upper() if rng.random() < 0.7 and items[n % 29][1] else make(40)) for n in range(60)]
    docs = [(n, t) for n, t in docs if t is not None]
    docs += [(100, None), (101, ""), (102, "\x00\x7f"), (103, "w1!w2 É"), (103, "w1!w2 É"), (None, items[4][1]), (104, make(30_000)), (105, "qq " * 5000), (106, items[12][1] + "x"), (107, items[12][1][:-1])]
    return docs, items


def brute_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            if n:
                windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = Counter()
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, named = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    named |= found - {None}
        out[doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("max_windows", [1 << 18, 40])
def test_op13(spark, max_windows):
    docs, items = contaminated_corpus()
    table = spark.createDataFrame([(i, t, "en", "clash", "clash", "clash") for i, t in docs], SCHEMA).repartition(3)
    got = decontamination.find(table, spark.createDataFrame(items, "item_id string, text string"), keep=("lang", "items"), max_windows=max_windows).collect()
    assert Counter(tuple(r[c] for c in decontamination.RESULTS[:6]) for r in got) == brute_hits(docs, items)
    assert {r["lang"] for r in got} == {"en"}
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t)
    for r in got:
        if len(texts[r["doc_id"]]) == 1:
            spans = [texts[r["doc_id"]][0][s["start"] : s["end"]] for s in r["spans"]]
            assert sum(len(WORD.findall(lower(s))) for s in spans) == r["n_hit"]
            assert all(s == s.strip() and s for s in spans)
    assert not any(x["items"] for x in got if not x["contaminated"])


def test_op13_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "", "", "")], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontamination.find(docs.limit(0), items).count() == 0
    assert [r["contaminated"] for r in decontamination.find(docs, items.limit(0)).collect()] == [False]
    assert [r["items"] for r in decontamination.find(docs, items).collect()] == [["1"]]


# vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    fine = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = max(Counter(len(v) for _, v, _ in fine).items(), key=lambda x: (x[1], x[0]))[0]
    top = math.isqrt(2**62 // d) // 2
    fine = [(i, [max(-top, min(top, math.floor(4096 * x))) for x in v], lab, v) for i, v, lab in fine if len(v) == d]
    order = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    cut = [(d * p // parts, d * (p + 1) // parts) for p in range(parts)]
    books = [[r[1][a:b] for r in order[:entries]] for a, b in cut]
    part = lambda r, p: r[1][cut[p][0] : cut[p][1]]
    near = lambda x, book: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for r in fine:
                own[near(part(r, p), books[p])[1]].append(part(r, p))
            for n, members in own.items():
                books[p][n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    coded = []
    for r in fine:
        found = [near(part(r, p), books[p]) for p in range(parts)]
        coded.append((r[0], "".join(f"{n:02x}" for _, n in found), sum(e for e, _ in found), r[2]))
    total = Counter()
    for _, _, e, lab in coded:
        total[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, total[lab], sha) for i, c, e, lab in coded)


def vectors(n, d, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)], rng.choice([1, 2, None])) for i in range(n)]
    hot = [0.25] * d
    rows += [(1000 + i, hot, 7) for i in range(n // 2)]  # a third of the rows are copies
    rows += [(3, rows[5][1], 1), (3, rows[5][1], 1), (None, rows[6][1], 2), (None, [1e300, -1e300] + [0.0] * (d - 2), None)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [math.nan] * d, 1), (2003, [math.inf] + [0.0] * (d - 1), 1), (2004, [None] * d, 1), (2005, [1.0] * (d + 1), 1), (2006, [0.0] * d, 1)]
    return rows


VECTORS = "vec_id long, embedding array<double>, label int, code string, _vec string"


@pytest.mark.parametrize(("n", "d", "owner_rows"), [(120, 16, 1 << 18), (200, 11, 20), (40, 5, 7)])
def test_op12(spark, monkeypatch, n, d, owner_rows):
    rows = vectors(n, d)
    monkeypatch.setattr(vector_codes, "OWNER_ROWS", owner_rows)
    monkeypatch.setattr(vector_codes.train, "__defaults__", (*vector_codes.train.__defaults__[:-1], owner_rows))
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(5)
    got = vector_codes.compress(table, keep=("code", "_vec")).collect()
    assert Counter(tuple(r[c] for c in vector_codes.RESULTS) for r in got) == brute_codes(rows)
    assert {r["_vec"] for r in got} == {"clash"}


def test_op12_few_and_no_rows(spark):
    rows = [(2, [0.5] * 8, 1), (1, [0.1] * 8, None), (4, None, 1)]
    got = vector_codes.compress(spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)).collect()
    assert Counter(tuple(r[c] for c in vector_codes.RESULTS) for r in got) == brute_codes(rows)
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0


def test_op12_checkpoints_and_moves_only_what_changes(spark, monkeypatch):
    rows = vectors(60, 8)
    monkeypatch.setattr(vector_codes, "CHECKPOINT_EVERY", 2)
    got = vector_codes.compress(spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)).collect()
    assert Counter(tuple(r[c] for c in vector_codes.RESULTS) for r in got) == brute_codes(rows)
    import numpy as np

    books = [np.array([[0], [10]])]
    members = [((0, 0, 5), np.array([[1], [9], [2]]))]
    assert [(k, b.ravel().tolist()) for k, b in vector_codes._split(books, True)(iter(members))] == [((0, 0, 5), [1, 2])]
    assert [(k, b.ravel().tolist()) for k, b in vector_codes._split(books, False)(iter(members))] == [((0, 1, 5), [9])]


# alignment of tokenizers


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = {i: t for t, i in a.get_vocab().items()}
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in keep} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in keep)}
    docs, count = [], Counter()
    for t in texts:
        xs, ys, whole = [], [], (" " + (t or "")).encode()
        if t:
            xs = [(i, bytes(letter[c] for c in names[i])) for i in a.encode(" " + t, add_special_tokens=False).ids]
            ys = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(t) for p in [b.id_to_piece(i)]]
            if b"".join(x for _, x in xs) != whole or b"".join(y for _, y in ys) != whole:
                xs, ys = [], []
        ends = []
        for tokens in (xs, ys):
            at, found = 0, {}
            for n, (_, x) in enumerate(tokens):
                at += len(x)
                found[at] = n
            ends.append(found)
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(xs[ends[0][e]][0], ys[ends[1][e]][0]) for e in common]
        count.update(links)
        groups, i, j = [], 0, 0
        for e in common:
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(str(x) for x, _ in xs[i:p]) + "|" + ",".join(str(y) for y, _ in ys[j:q]))
            i, j = p, q
        docs.append((len(xs), len(ys), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(x, y, len(links), len(links), sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(g.encode()).hexdigest() if x else "") for x, y, links, g in docs]


def odd_texts():
    rng = random.Random(8)
    words = ["the", "Häuser", "naïve", "don't", "we'll", "x=1;", "日本語", "🙂🏽", "Москва", "1234567", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "é", "ﬁ", " ", " x", "a​b", "—", "…", "I'M", "''s"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", "　", "   ", "\x0b", "\x1c", "\x85", "\xa0"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += ["".join(rng.choice(gaps) + rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    texts += [None, "", " ", "  ", "\n", "\n ", " \n", "a\n", "a ", " a", "a▁b", "▁", "x ▁ y", "\x00", "a\x00b", "the same text", "the same text", "word " * 20_000, "x" * 3000, "ab\n" * 3000]
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_op11(spark, monkeypatch, small):
    from whenwhere.llm import alignment

    texts = odd_texts()
    table = spark.createDataFrame([(n if n % 50 else None, t, str(n), "", "", "clash") for n, t in enumerate(texts)], SCHEMA).repartition(5)
    if small:  # trees of more levels; the workers' own bounds are looked at below
        monkeypatch.setattr(alignment, "FAN", 2)
    got = alignment.align(table, keep=("lang", "_text")).collect()
    want = brute_alignment(texts)
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in alignment.RESULTS[1:]) == want[int(r["lang"])], texts[int(r["lang"])]
    assert {r["_text"] for r in got} == {"clash"}


def test_op11_whole_texts_and_forgetting_give_the_same(spark, monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from whenwhere.llm import alignment

    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligner = alignment.Aligner(*paths, True)
    assert aligner.cut
    for cut in (True, False):
        aligner.forget()
        for text, (n_a, n_b, n, _, _, _, sha) in zip(odd_texts(), brute_alignment(odd_texts()), strict=True):
            codes, names, ends = alignment.units(pa.array([text], pa.string()), cut)
            at = aligner.look_up(names)[0][codes]
            if text and aligner.ok[at].all():
                assert (aligner.n_a[at].sum(), aligner.n_b[at].sum(), aligner.size[at].sum()) == (n_a, n_b, n)
                assert hashlib.sha256(";".join(aligner.text[u] for u in at).encode()).hexdigest() == sha
            else:
                assert n_a == 0 == len(sha)


def test_perfect_hash_is_minimal_and_verified():
    import numpy as np

    from whenwhere.llm import alignment

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000, 200_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        built = alignment.PerfectHash.build(keys)
        assert (np.sort(built.index(keys)) == np.arange(len(keys))).all()
        assert (built.index(np.setdiff1d(rng.integers(0, 2**63, 1000, dtype=np.uint64), keys)) == -1).all()
        assert len(built.words) * 64 < 7 * max(n, 100)


def test_op11_empty_table(spark):
    from whenwhere.llm import alignment

    table = spark.createDataFrame([(1, None, "", "", "", ""), (2, "", "", "", "", "")], SCHEMA)
    assert alignment.align(table.limit(0)).count() == 0
    assert {tuple(r)[1:] for r in alignment.align(table).collect()} == {(0, 0, 0, 0, 0, 0, "")}
