"""Landed pages and numbered parts: what is read, what is pruned, what a failed job leaves."""

import json

import pytest
from pyspark.sql import functions as F

from whenwhere.sources import landed


@pytest.fixture
def root(tmp_path):
    pages = {
        "20250101/site_a.md": "https://e.org/x \nline one\nline two", "20250101/site_b.md": "no address\ntext", "20250102/site_a.md": "", "20250103_late/site_a.md": "https://e.org/only",
        "20250104/site_a.md": b"http://h\n\xff bytes", "20250104/notes.txt": "x", "other/site_a.md": "x", "20250105": "a file",
    }
    for name, text in pages.items():
        path = tmp_path / "crawled" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{tmp_path}/crawled"


def shown(df):
    return sorted((r["crawl_date"], r["site"], r["source_url"], r["body"]) for r in df.collect())


def test_reads(spark, root, tmp_path):
    got = landed.read_pages(spark, root)
    assert shown(got) == [
        ("20250101", "site_a", "https://e.org/x", "line one\nline two"), ("20250101", "site_b", None, "no address\ntext"), ("20250102", "site_a", None, ""),
        ("20250103", "site_a", "https://e.org/only", ""), ("20250104", "site_a", "http://h", "� bytes"),
    ]
    assert shown(landed.read_pages(spark, root, "any").where("site = 'site_b'")) == [("20250101", "site_b", "no address", "text")]
    assert landed.read_pages(spark, f"file://{tmp_path}/nothing").count() == 0


def test_filters_prune(spark, root, tmp_path):
    reader = landed.PageReader(root, "http")
    left = list(reader.pushFilters([landed.ds.GreaterThanOrEqual(("crawl_date",), "20250102"), landed.ds.EqualTo(("site",), "site_a"), landed.ds.EqualTo(("body",), "x")]))
    assert [f.attribute for f in left] == [("body",)]
    (files,) = reader.partitions()
    assert [p.split("/")[-2] for p in sorted(files.paths)] == ["20250102", "20250103_late", "20250104"]
    got = landed.read_pages(spark, root)
    for rule in ("crawl_date = '20250101'", "crawl_date in ('20250102', '20250104')", "crawl_date > '20250101' and site = 'site_a'", "site like '%_b'", "crawl_date like '202501%' and body <> ''", "site is null", "crawl_date <=> null"):
        want = [r for r in spark.createDataFrame(got.collect(), got.schema).where(rule).collect()]
        assert sorted(map(tuple, got.where(rule).collect())) == sorted(map(tuple, want)), rule
    # a folder that a filter prunes is not even listed
    (tmp_path / "crawled/20250109").symlink_to(tmp_path / "gone")
    assert got.where("crawl_date < '20250109'").count() == 5


def test_files_are_dealt_by_size(root, monkeypatch):
    monkeypatch.setattr(landed, "GROUP_BYTES", 100_000)
    assert sorted(len(p.paths) for p in landed.PageReader(root, "http").partitions()) == [1, 2, 2]


def test_writes_and_reads_back(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = [("20250101", "Café No. 1", "https://x", "a\nb"), ("20250101", "b", None, None), ("20250102", "b", "https://y", "ü")]
    make = lambda rows: spark.createDataFrame(rows, "crawl_date string, site string, source_url string, body string")
    landed.write_pages(make(rows).withColumn("extra", F.lit(1)), root)
    assert shown(landed.read_pages(spark, root)) == [("20250101", "b", None, ""), ("20250101", "café_no_1", "https://x", "a\nb"), ("20250102", "b", "https://y", "ü")]
    landed.write_pages(make([("20250102", "B", "https://z", "new")]), root)
    assert shown(landed.read_pages(spark, root))[-1] == ("20250102", "b", "https://z", "new")
    before = shown(landed.read_pages(spark, root))
    for bad in ([("20250103", "ok", None, "x"), (None, "b", None, "x")], [("20250103", "c d", None, "x"), ("20250103", "C D", None, "y")], [("2025", "b", None, "x")], [("20250103", "?!", None, "x")]):
        with pytest.raises(Exception, match="two pages|needs a date"):
            landed.write_pages(make(bad), root)
        assert shown(landed.read_pages(spark, root)) == before
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["20250101", "20250102"]


def test_parts_keep_their_order(spark, tmp_path):
    root = f"file://{tmp_path}/parts"
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("n"), F.lit('é"').alias("t"))
    landed.write_parts(rows.repartitionByRange(4, "n").sortWithinPartitions("n"), root)
    names = sorted(p.name for p in (tmp_path / "parts").iterdir())
    assert names == [f"part-{i:05d}.json" for i in range(4)]
    assert [r["n"] for name in names for r in json.loads((tmp_path / "parts" / name).read_text())] == list(range(1000))
    back = landed.read_parts(spark, root, "n long, t string").orderBy("part", "place").collect()
    assert [r["n"] for r in back] == list(range(1000)) and back[0]["t"] == 'é"'
    failing = rows.select(F.when(F.col("n") == 500, F.raise_error("stop")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="stop"):
        landed.write_parts(failing, root)
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == names
    landed.write_parts(rows.limit(0).coalesce(1), root)
    assert [json.loads(p.read_text()) for p in (tmp_path / "parts").iterdir()] == [[]]


def test_parts_are_bounded_whatever_a_task_has(spark, tmp_path):
    root = f"file://{tmp_path}/parts"
    rows = spark.range(3000).select(F.col("id").alias("n"), F.repeat(F.lit("x"), 20).alias("t"))
    landed.write_parts(rows.repartitionByRange(3, "n").sortWithinPartitions("n"), root, 4_000)
    names = sorted(p.name for p in (tmp_path / "parts").iterdir())
    assert len(names) > 20 and names == [f"part-{i:05d}.json" for i in range(len(names))]
    assert all(p.stat().st_size < 4_100 for p in (tmp_path / "parts").iterdir())
    assert [r["n"] for name in names for r in json.loads((tmp_path / "parts" / name).read_text())] == list(range(3000))
    back = landed.positions(landed.read_parts(spark, root, "n long")).collect()
    assert sorted((r["n"], r["position"]) for r in back) == [(n, n) for n in range(3000)]
