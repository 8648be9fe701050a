"""Counts by signed changes, against fresh counts."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from whenwhere.operators import signed as C

rng = random.Random(21)
BASE = dt.datetime(2024, 1, 1)
EVENTS = [(i, rng.choice([1, 2, 3, None]), rng.sample("ABCD", rng.randrange(0, 4))) for i in range(60)]
OCC = [(rng.randrange(60), (a := BASE + dt.timedelta(hours=rng.randrange(24 * 30))), a + dt.timedelta(hours=rng.randrange(0, 60))) for _ in range(150)] + [(0, None, BASE), (1, BASE, None)]


@pytest.fixture(scope="module")
def tables(spark):
    words = spark.createDataFrame([(t,) for t in "ABCDX"], "tag string")
    return spark.createDataFrame(EVENTS, "id long, loc_id long, tags array<string>"), spark.createDataFrame(OCC, "id long, start timestamp_ntz, end timestamp_ntz"), words


def fresh(ids):
    places = defaultdict(set)
    for i, loc, tags in EVENTS:
        for t in tags if i in ids else ():
            places[t].add(loc)
    return {t: len(places[t]) for t in "ABCDX"}


def test_windows(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "MOST_VERSIONS", 3)
    events, occ, words = tables
    facets = C.Facets.start(spark, f"file://{tmp_path}/f")
    day = lambda n: BASE + dt.timedelta(days=n)
    for a, b in [(3, 9), (5, 9), (4, 12), (4, 12), (20, 25), (26, 24), (0, 40)]:
        facets = facets.at(events, occ, (F.lit(day(a)).cast("timestamp_ntz"), F.lit(day(b)).cast("timestamp_ntz")))
        ids = {i for i, s, e in OCC if s and e and s <= day(b) and e >= day(a)}
        assert {r["tag"]: r["frequency"] for r in facets.frequency(words).collect()} == fresh(ids), (a, b)
    with pytest.raises(ValueError):
        facets.of(events, events)


def test_sets(spark, tables, tmp_path):
    events, _, words = tables
    facets = C.Facets.start(spark, f"file://{tmp_path}/f")
    for n in (20, 0, 45, 44):
        ids = set(rng.sample(range(60), n))
        facets = facets.of(events, spark.createDataFrame([(i,) for i in [*ids, *ids]], "id long"))
        assert {r["tag"]: r["frequency"] for r in facets.frequency(words).collect()} == fresh(ids)


def test_changes(spark, tmp_path):
    counts, want = C.Counts(spark, f"file://{tmp_path}/c", (("k", "string"), ("j", "long"))), Counter()
    make = lambda rows: spark.createDataFrame(rows, "k string, j long, d long")
    for step in [[("a", 1, 2), (None, None, 1), ("a", 1, 1), ("b", 1, 1)], [("a", 1, -3), (None, None, 1)], [("b", 1, 1), ("b", 1, -1)], []]:
        before = dict(want)
        for k, j, d in step:
            want[k, j] += d
        counts, seen = counts.changed(make(step))
        assert {(r["k"], r["j"]): (r["was"], r["now"]) for r in seen.collect()} == {k: (before.get(k, 0), n) for k, n in want.items() if n != before.get(k, 0)}
        assert {(r["k"], r["j"]): r["n"] for r in counts.table().collect()} == {k: n for k, n in want.items() if n}
    assert {(r["k"], r["j"]): r["n"] for r in counts.together().table().collect()} == {k: n for k, n in want.items() if n}
    with pytest.raises(Exception, match="more went than ever came"):
        counts.changed(make([("b", 1, -2)]))


def test_a_change_reads_its_own_folders(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("id as k", "1L as d")
    counts, _ = C.Counts(spark, f"file://{tmp_path}/c", (("k", "long"),)).changed(rows)
    old = counts._log([7])
    plan = old._jdf.queryExecution().executedPlan()
    n = len(plan.executeCollectPublic())
    assert n == plan.collectLeaves().head().metrics().apply("numOutputRows").value() < 100_000 / C.BUCKETS * 1.3
