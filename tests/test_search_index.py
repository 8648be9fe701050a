"""The trigram index against a look into every text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from whenwhere.functions import text
from whenwhere.operators import search_index as S

rng = random.Random(6)
WORDS = ["Café", "NAÏVE", "über", "日本", "🙂", "concert", "Concerto", "a", "aa", "aaa", "x-y", "Ñandú", "o'clock"]
RAW = [("event", str(n), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 7)))) for n in range(300)]
RAW += [("tag", w, w) for w in WORDS] + [("tag", "a", "a")] * 2 + [("event", None, "aaa"), (None, "1", "ñandu"), ("event", "e", ""), ("event", "n", None), ("event", "long", "lorem " * 20_000 + "finis")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    entries = spark.createDataFrame(RAW, "type string, ref string, text string").withColumn("text", text.search_form(F.col("text"))).repartition(5)
    return S.write(entries, f"file://{tmp_path_factory.mktemp('index')}/i", block_rows=40)


@pytest.mark.parametrize("term", ["cafe", "CAFÉ", "ber", "a", "aa", "aaa", "aaaa", "日", "日本", "🙂", "concert conc", "x-y", "nandu", "o'c", "finis", "lorem lorem lorem lorem lorem finis", "nothing like it", "em f", " ", "  ", "zz"])
def test_terms(index, term):
    form = S.term_form(term)
    want = Counter((t, r, S.term_form(x) == form) for t, r, x in RAW if x and form in S.term_form(x))
    assert Counter(tuple(r) for r in index.find(term).collect()) == want


def test_nothing_is_found_by_an_empty_term_or_in_an_empty_index(spark, index, tmp_path):
    assert index.find("").count() == 0
    empty = S.write(spark.createDataFrame([], "type string, ref string, text string"), f"file://{tmp_path}/i")
    assert empty.find("abc").count() == 0


def test_the_form_of_a_term_is_that_of_the_texts(spark):
    terms = [*WORDS, "İstanbul", "ﬁ", "Å", "ΆΣ", "한국"]
    got = spark.createDataFrame([(t,) for t in terms], "t string").select(text.search_form(F.col("t"))).collect()
    assert [r[0] for r in got] == [S.term_form(t) for t in terms]


def test_a_search_reads_its_grams_and_has_no_python(index):
    plan = index.find("concerto")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "In(gram" in plan.replace("gram IN", "In(gram") and "PushedFilters: [In(gram" in plan
    assert index.texts.rdd.getNumPartitions() and index.postings.agg(F.max("n")).first()[0] <= 2 * 40


def test_no_pairs_of_gram_and_place_are_shuffled_and_blocks_are_bounded_by_letters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_LETTERS", 5_000)
    entries = spark.createDataFrame([("event", str(n), f"{n} " + "abc" * 300) for n in range(60)], "type string, ref string, text string")
    index = S.write(entries, f"file://{tmp_path}/i")
    plan = S.postings_of(index.texts, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == plan.count("Exchange") == 1 and "explode" not in plan
    assert index.texts.select("block").distinct().count() > 5
    assert index.find("bca").count() == 60 and {r["ref"] for r in index.find("17 a").collect()} == {"17"}
