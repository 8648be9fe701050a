"""Places clustered by cell, against tests of every place."""

import math
import random

import pytest

from whenwhere.operators import cells as Z

rng = random.Random(9)
SPOTS = [(rng.uniform(40, 41), rng.uniform(-75, -73)) for _ in range(1500)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(1500)]
SPOTS += [(0.0, 0.0)] * 1500 + [(90.0, 180.0), (-90.0, -180.0), (95.0, 200.0), (-200.0, -1e300), (0.0, 179.999), (0.0, -179.999), (None, 1.0), (1.0, None), (math.nan, 0.0)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SPOTS)], "loc_id long, lat double, lng double")
    return Z.write(rows, f"file://{tmp_path_factory.mktemp('cells')}/t")


def parity(lat, lng, corners):
    inside = False
    for (y1, x1), (y2, x2) in zip(corners, corners[-1:] + corners[:-1], strict=True):
        if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_views(table):
    for n in range(8):
        y, x, r = (40.5, -74, 0.3) if n % 2 else (rng.uniform(-80, 80), rng.uniform(-170, 170), 60)
        corners = [(y - r * rng.random(), x - r), (y - r, x + r * rng.random()), (y + r, x + r), (y + r * rng.random(), x - r * rng.random())]
        want = [i for i, (a, b) in enumerate(SPOTS) if None not in (a, b) and parity(a, b, corners)]
        assert sorted(r["loc_id"] for r in table.in_view(corners).collect()) == want


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 6_371_000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("at", [(40.7, -74.0, 20_000), (0.0, 179.9995, 500), (0.0, -179.9995, 500), (89.5, 10.0, 300_000), (-60.0, 100.0, 5_000_000), (0.0, 0.0, 0.0)])
def test_circles(table, at):
    want = [i for i, (a, b) in enumerate(SPOTS) if None not in (a, b) and abs(a) <= 90 and abs(b) <= 180 and metres(a, b, at[0], at[1]) <= at[2]]
    assert want
    found = table.near(*at).where("abs(lat) <= 90 and abs(lng) <= 180")
    assert sorted(r["loc_id"] for r in found.collect()) == want


def test_ranges_hold_the_box_and_are_few():
    for _ in range(200):
        south, north = sorted(rng.uniform(-90, 90) for _ in range(2))
        west, east = sorted(rng.uniform(-180, 180) for _ in range(2))
        found = Z.ranges((south, west, north, east))
        assert 0 < len(found) <= Z.MOST_RANGES and all(a <= b for a, b in found) and all(b + 1 < c for (_, b), (c, _) in zip(found, found[1:], strict=False))
    assert Z.ranges((1, 0, 0, 0)) == []
    assert Z.ranges((-90, -180, 90, 180)) == [(0, 4**Z.BITS - 1)]


def test_a_view_reads_a_part(spark, tmp_path):
    rows = spark.range(400_000).selectExpr("id as loc_id", "(id * 7919 % 180000) / 1000.0D - 90 as lat", "(id * 104729 % 360000) / 1000.0D - 180 as lng")
    table = Z.write(rows, f"file://{tmp_path}/t")
    view = table.in_view([(40.6, -74.1), (40.6, -73.1), (41.2, -73.1), (41.2, -74.1)])
    plan = view._jdf.queryExecution().executedPlan()
    n = len(plan.executeCollectPublic())
    assert n == rows.where("lat > 40.6 and lat <= 41.2 and lng >= -74.1 and lng < -73.1").count() > 0
    read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert read < 400_000 / 10
    assert "GreaterThanOrEqual(cell" in plan.toString()


def test_empty(spark, tmp_path):
    rows = spark.createDataFrame([], "loc_id long, lat double, lng double")
    table = Z.write(rows, f"file://{tmp_path}/t")
    assert table.places.columns == ["loc_id", "lat", "lng", "cell"] and table.near(0.0, 0.0, 1e9).count() == 0
