"""The written tag index and the join of ranges against plain loops."""

import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from whenwhere.operators import tag_index as T
from whenwhere.operators import view as V
from whenwhere.operators import windows as N

rng = random.Random(4)
EVENTS = {i: sorted({rng.choice("ABCDEF") for _ in range(rng.randrange(0, 4))}) for i in rng.sample(range(-200_000, 400_000), 400)}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame([*EVENTS.items(), next(iter(EVENTS.items())), (None, ["A"]), (1_000_000, [None])], "id long, tags array<string>")
    return T.write(rows.select("id", F.explode("tags").alias("tag")), rows.select("id"), f"file://{tmp_path_factory.mktemp('tags')}/i")


def test_filters(spark, index):
    events = spark.createDataFrame([*EVENTS.items(), (1_000_000, [])], "id long, tags array<string>")
    for n in range(25):
        some = lambda k: tuple(rng.sample("ABCDEFX", rng.randrange(0, k)))
        states = V.TagStates(selected=some(3), required=some(3) if n % 2 else (), forbidden=some(3), implicit=some(2)) if n else V.TagStates(required=("A", "A", "B"))
        want = sorted(r["id"] for r in events.where(V.matches(F.col("tags"), states)).collect())
        assert sorted(r["id"] for r in index.matching(states).collect()) == want, states


def test_stats_and_what_a_filter_reads(spark, index, tmp_path):
    got = {r["tag"]: (r["n_events"], r["first_id"], r["last_id"]) for r in index.stats().collect()}
    for tag in "ABCDEF":
        ids = [i for i, t in EVENTS.items() if tag in t]
        assert got[tag] == (len(ids), min(ids), max(ids))
    plan = index.matching(V.TagStates(required=("A", "C")))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(tag, [A,C])" in plan or "In(tag, [A,C])" in plan
    empty = spark.createDataFrame([], "id long, tag string")
    assert T.write(empty, empty.select("id"), f"file://{tmp_path}/i").matching(V.TagStates()).count() == 0


@pytest.mark.parametrize("days", [1, 7, 30])
def test_overlaps_of_many_windows(spark, days):
    base = dt.datetime(1969, 12, 20)
    moment = lambda: base + dt.timedelta(hours=rng.randrange(24 * 60))
    make = lambda n, longest: [(i, (a := moment()), a + dt.timedelta(hours=rng.randrange(-3, longest))) for i in range(n)]
    events, windows = [*make(60, 24 * 20), (60, None, base), (61, base, None), (60, base, base), (60, base, base)], [*make(25, 200), (26, base, base)]
    e = spark.createDataFrame(events, "id long, start timestamp_ntz, end timestamp_ntz")
    w = spark.createDataFrame(windows, "win long, `from` timestamp_ntz, `to` timestamp_ntz")
    want = Counter((a[0], b[0]) for a, b in itertools.product(events, windows) if a[1] and a[2] and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and a[2] >= b[1])
    found = N.overlapping(e, w, days)
    assert Counter((r["id"], r["win"]) for r in found.collect()) == want
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert N.overlapping(e, w.limit(0), days).count() == 0
