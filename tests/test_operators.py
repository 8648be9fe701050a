import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from whenwhere.functions.tags import TagRules
from whenwhere.operators import alike
from whenwhere.operators import listing as L
from whenwhere.operators import view as V
from whenwhere.sources import files
from whenwhere.streaming import incremental

HEAD = "| " + " | ".join(L.HEADER) + " |\n|---|---|\n"


def test_table_rows_are_kept_joined_or_dropped(spark):
    body = HEAD + "| LATE JAZZ | Harbor Hall | Roof | 2025-10-04 | 7:00 PM | | 9:30 PM | Live<br>out | https://e.org/j | #LatinJazz | 🎷 |\n| Talk | Part Two | Harbor Hall | N/A | 2025-10-05 | 6:30 p.m. | | | x | https://e.org/t | #QAndA | 💡 |\n| broken row | too few |\n\n| a | b | c | 2025-10-04 | 1 | | 2 | d | u | #t |"
    rows = L.parse_tables(spark.createDataFrame([("f", body), ("g", ""), ("h", None)], "file string, body string")).orderBy("row_no").collect()
    assert [r["name"] for r in rows] == ["LATE JAZZ", "Talk | Part Two", "a"]
    assert rows[0]["description"] == "Live out"
    assert rows[1]["start_date"] == "2025-10-05"
    assert rows[2]["emoji"] == ""


def test_chunks_cut_at_headings_then_blank_lines():
    text = "a" * 50 + "\n## b\n" + "c" * 60 + "\n\n" + "d" * 80
    got = L.cut_chunks(text, 100)
    assert got[0] == "a" * 50
    assert all(len(c) <= 100 for c in got)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert L.cut_chunks("", 10) == []


def greedy(names):
    """The rule, name by name."""
    groups, out = {}, []
    for i, n in enumerate(names):
        if n in groups:
            out.append(groups[n])
            continue
        p = L._plain(n)
        for k, at in groups.items():
            q = L._plain(k)
            if p == q or (len(p) >= 5 and len(q) >= 5 and (p in q or q in p)):
                out.append(at)
                break
        else:
            groups[n] = i
            out.append(i)
    return out


def test_fuzzy_groups_follow_the_order(spark):
    rng = random.Random(1)
    words = ["jazz night", "Jazz Night!", "late jazz night", "opera", "Opera_", "talk", "talks", "night"]
    rows = [(f, i, rng.choice(words)) for f in ("a", "b") for i in range(40)]
    got = L.group_fuzzy(spark.createDataFrame(rows, "file string, row_no long, name string"), "file", "row_no").collect()
    for f in ("a", "b"):
        names = [n for x, _, n in rows if x == f]
        assert [r["key_at"] for r in sorted((r for r in got if r["file"] == f), key=lambda r: r["row_no"])] == greedy(names)


def odd_names(rng, n):
    """Names that hold one another at random: runs of few letters, variants in case and punctuation, long ones around a common passage, empty ones."""
    base = ["".join(rng.choice("ab ") for _ in range(rng.randrange(3, 24))) for _ in range(n // 2)]
    passage = "the grand annual midsummer concert"
    base += [" ".join(rng.choice(["The", "grand", "annual", passage, "x", "night", "été", "日本語の祭り"]) for _ in range(rng.randrange(1, 6))) for _ in range(n // 2)]
    return [rng.choice([b, b.upper(), f"_{b}_", b + "!", b[: len(b) // 2], "  ", "²³ " + b]) for b in base]


def test_parallel_groups_against_the_rule(spark):
    rng = random.Random(12)
    rows = [(f, i, n) for f in ["a", "b", None, "c"] + [f"f{k}" for k in range(30)] for i, n in enumerate(odd_names(rng, 60 if f in ("a", "b", None) else 8)) if n]
    df = spark.createDataFrame(rows, "file string, row_no long, name string").repartition(7)
    got = {(r["file"], r["row_no"]): r["key_at"] for r in L.group_fuzzy(df, "file", "row_no").collect()}
    for f in {r[0] for r in rows}:
        mine = [(i, n) for g, i, n in rows if g == f]
        assert [got[f, i] for i, _ in mine] == [mine[k][0] for k in greedy([n for _, n in mine])]


def test_names_meet_alike_in_small_and_in_large_pages(spark):
    """A page's names are paired off or meet by runs, with the same pairs; only large pages write runs."""
    from pathlib import Path

    rng = random.Random(9)
    emoji = ["\U0001D4D0\U0001D4D1 and the whole orchestra", "x \U0001D4D0\U0001D4D1 and the whole orchestra \U0001D4D2", "\U0001D4D1 and the", "\U0001D4D0\U0001D4D0\U0001D4D0\U0001D4D1\U0001D4D2", "b\U0001D4D0\U0001D4D0\U0001D4D0\U0001D4D1\U0001D4D2"]
    rows = {(f, L._plain(n)): i for f in "abc" for i, n in enumerate(odd_names(rng, 60) + emoji)}
    df = spark.createDataFrame([(f, p, i) for (f, p), i in rows.items()], "file string, plain string, at long")
    wanted = {(f, min(i, j), max(i, j)) for (f, p), i in rows.items() for (g, q), j in rows.items() if f == g and 5 <= len(q) < len(p) and q in p}
    runs = lambda: len(list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("runs-*")))
    before = runs()
    assert {tuple(r) for r in alike.alike(df, ["file"]).collect()} == wanted and runs() == before
    for bounds in ({"few": 1}, {"few": 70}, {"looks": 1}, {"looks": 50_000}):
        assert {tuple(r) for r in alike.alike(df, ["file"], **bounds).collect()} == wanted
    assert runs() > before


def test_plain_names_in_columns_and_in_python(spark):
    names = ["_A_ b", "É²½Ⅳ x", "a\u200bb\u0301c", "İX ΑΣ", "x\x1cy\x85z\xa0", "tab\t\n new", "👍 ok", "a‿b", "", None, "१२ ३", "\u3000full\u2003width"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(alike.plain_name(F.col("n"))).collect()
    assert [r[0] for r in got] == [L._plain(n) for n in names]


def test_one_page_with_many_rows_is_many_tasks(spark):
    rng = random.Random(2)
    names = [f"talk {rng.randrange(10**6)} {rng.choice('abc')}" for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(names)), "row_no long, name string").withColumn("file", F.lit("one"))
    found = L.group_fuzzy(df, "file", "row_no")
    assert "Pandas" not in found._jdf.queryExecution().toString()
    assert found.where("key_at > row_no").count() == 0 and found.count() == 20_000
    assert found.select("key_at").distinct().count() == len({k for k in greedy_by_index(names)})


def greedy_by_index(names):
    """The rule over 5-character beginnings, for names that all are of one form: a name holds another only if it begins or ends like it."""
    openers, out, seen = {}, [], {}
    for i, n in enumerate(names):
        p = L._plain(n)
        if p in seen:
            out.append(seen[p])
            continue
        inside = [openers[p[a:b]] for a in range(len(p)) for b in range(a + 5, len(p) + 1) if p[a:b] in openers]
        around = [at for q, at in openers.items() if len(q) > len(p) and p in q] if len(p) < 12 else []
        seen[p] = min(inside + around, default=i)
        if seen[p] == i:
            openers[p] = i
        out.append(seen[p])
    return out


def test_dedup_on_spark_against_the_rule(spark):
    rng = random.Random(13)
    rows = []
    for spot in range(25):
        for n in odd_names(rng, 80 if spot == 0 else 10):
            rows.append((len(rows), n, rng.choice(["", "d", "dd", None]), None if spot == 3 else [0.0, -0.0][spot == 0 and rng.random() < 0.5] + (spot > 0) * spot, 1.0, [{"start_date": "2025-01-01"}] if spot != 4 else None))
    df = spark.createDataFrame(rows, "pos long, name string, description string, lat double, lng double, occurrences array<struct<start_date:string>>").repartition(5)
    got = {r["pos"]: r["kept_pos"] for r in L.dedup_fuzzy(df).collect()}
    want = {}
    for key in {(r[3], r[4], str(r[5])) for r in rows}:
        want |= literal_dedup([(r[0], r[1], len(r[2] or "")) for r in rows if (r[3], r[4], str(r[5])) == key])
    assert got == want


def test_fuzzy_dedup_keeps_the_shorter_name(spark):
    one = [{"start_date": "2025-01-01"}]
    rows = [(0, "The Big Show", "x", 1.0, 1.0, one), (1, "Big Show", "y", 1.0, 1.0, one), (2, "Other", "z", 1.0, 1.0, one), (3, "Big Show", "longer", 1.0, 1.0, one), (4, "Big Show", "y", 2.0, 1.0, one)]
    df = spark.createDataFrame(rows, "pos long, name string, description string, lat double, lng double, occurrences array<struct<start_date:string>>")
    assert {r["pos"]: r["kept_pos"] for r in L.dedup_fuzzy(df).collect()} == {0: 3, 1: 3, 2: 2, 3: 3, 4: 4}


def test_locating(spark):
    places = spark.createDataFrame([(0, "Harbor Hall", "Harbor", ["The Harbor Hall Theater"], 1.0, 2.0, "H"), (1, "Apollo Theater", None, None, 3.0, 4.0, "A")], "pos long, name string, short_name string, alternate_names array<string>, lat double, lng double, emoji string")
    rows = spark.createDataFrame([(0, "Harbor Hall", "", "x", "s"), (1, "Apollo Theater Main Stage", "", "x", "s"), (2, "harbor", "", "x", "s"), (3, "nowhere", "", "x", "Apollo Theatre"), (4, "nowhere", "", "x", "s")], "id long, location string, sublocation string, name string, site string")
    got = {r["id"]: r["place"] and r["place"]["emoji"] for r in L.locate(rows, places, "id", "site").collect()}
    assert got == {0: "H", 1: "A", 2: "H", 3: "A", 4: None}
    fuzzy = L.match_fuzzy(L.search_keys(rows), L.gazetteer(places), "id").where("id = 1").first()
    assert fuzzy["score"] == pytest.approx(0.9504, abs=1e-4)


def test_tag_states(spark):
    df = spark.createDataFrame([(1, ["A", "B"]), (2, ["B"]), (3, ["C"]), (4, [])], "id long, tags array<string>")
    ids = lambda s: sorted(r["id"] for r in df.where(V.matches(F.col("tags"), s)).collect())
    assert ids(V.TagStates()) == [1, 2, 3, 4]
    assert ids(V.TagStates(selected=("A", "C"))) == [1, 3]
    assert ids(V.TagStates(required=("B",), selected=("C",))) == [1, 2]
    assert ids(V.TagStates(forbidden=("B",))) == [3, 4]
    assert ids(V.TagStates(selected=("A",), implicit=("C",), forbidden=("B",))) == [3]


def test_tag_score_needs_two_choices(spark):
    row = spark.createDataFrame([(["Contemporary Art"],)], "t array<string>")
    assert row.select(V.tag_score(F.col("t"), {"Art": 1.0, "Contemporary Art": 0.8}, V.Weights())).first()[0] == pytest.approx(2.4)
    assert row.select(V.tag_score(F.col("t"), {"Art": 1.0}, V.Weights())).first()[0] == 0


def test_files(spark, tmp_path):
    (tmp_path / "crawled/20250101").mkdir(parents=True)
    (tmp_path / "crawled/20250101/site_a.md").write_text("https://e.org/\nline one\nline two")
    row = files.read_pages(spark, str(tmp_path / "crawled")).first()
    assert (row["crawl_date"], row["site"], row["source_url"], row["body"]) == ("20250101", "site_a", "https://e.org/", "line one\nline two")
    (tmp_path / "rules.json").write_text('{"rewrite": {"a": "B"}, "exclude": ["c"]}')
    assert files.read_tag_rules(spark, str(tmp_path / "rules.json")) == TagRules({"a": "B"}, ("c",), ())
    assert files.read_tag_rules(spark, str(tmp_path / "none.json")) == TagRules()
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.json").write_text('[{"name": "n", "lat": 1.0, "lng": 2.0, "url": "u", "occurrences": [["2025-01-01", "", "", ""]]}]')
    assert files.read_events(spark, str(tmp_path / "p")).first()["urls"] == ["u"]


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put = lambda rows: spark.createDataFrame(pd.DataFrame(rows, columns=["k", "at"]).astype({"at": "datetime64[us]"})).write.mode("append").parquet(src)
    put([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:00:01"), ("b", "2025-01-01 00:00:00")])
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        incremental.drain(incremental.first_seen(incremental.arrivals(spark, src, schema), ["k"], "at"), out, state)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    put([("c", "2025-01-02 00:00:00"), ("a", "2025-01-01 00:00:05")])
    incremental.drain(incremental.first_seen(incremental.arrivals(spark, src, schema), ["k"], "at"), out, state)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_query_events(spark):
    import datetime as dt

    from whenwhere.plans import view

    raw = spark.createDataFrame(
        [("a", "N/A", "None given", "🇫🇷", 1.0, 2.0, [("2025-07-04", "7pm", "", "9pm"), ("bad", "", "", ""), ("2025-07-01", "", "", "")]), ("b", "x", "", "y", None, 2.0, []), ("c", "x", "", "y", 1.0, 2.0, [("2020-01-01", "", "", "")])],
        "name string, location string, sublocation string, emoji string, lat double, lng double, occurrences array<struct<start_date:string,start_time:string,end_date:string,end_time:string>>",
    )
    places = spark.createDataFrame([(1.0, 2.0, "P")], "lat double, lng double, emoji string")
    rows = view.query_events(raw, places, F.lit(dt.datetime(2025, 1, 1)), F.lit(dt.datetime(2026, 1, 1))).collect()
    assert [r["name"] for r in rows] == ["a"]
    assert (rows[0]["location"], rows[0]["sublocation"], rows[0]["emoji"], rows[0]["location_key"]) == ("", "", "P", "1.0,2.0")
    assert [o["start_time"] for o in rows[0]["occurrences"]] == ["", "7pm"]
    assert view.default_range(dt.date(2025, 9, 1), dt.date(2025, 8, 1), dt.date(2025, 9, 3)) == (dt.date(2025, 9, 1), dt.date(2025, 9, 3))
    assert view.default_range(dt.date(2026, 9, 1), dt.date(2025, 8, 1), dt.date(2025, 9, 3))[0] == dt.date(2025, 8, 1)


def test_archive_moves_by_the_store(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("1")
    assert files.archive(spark, f"file://{tmp_path}/a/x.md", f"file://{tmp_path}/old/x.md")
    assert (tmp_path / "old/x.md").read_text() == "1" and not (tmp_path / "a").exists()
    assert not files.archive(spark, f"file://{tmp_path}/a/x.md", f"file://{tmp_path}/old/x.md")


def literal_dedup(events):
    """The rule as it reads: each event against the kept ones in order, by their current names."""
    kept = []
    for pos, name, n in events:
        plain = L._plain(name)
        for k in kept:
            other = L._plain(k["name"])
            if plain == other or (len(plain) >= 5 and len(other) >= 5 and (plain in other or other in plain)):
                k["members"].append(pos)
                if len(name) < len(k["name"]) or (len(name) == len(k["name"]) and n > k["n"]):
                    k.update(name=name, n=n, pos=pos)
                break
        else:
            kept.append({"name": name, "n": n, "pos": pos, "members": [pos]})
    return {m: k["pos"] for k in kept for m in k["members"]}


def test_dedup_against_the_rule():
    rng = random.Random(5)
    texts = ["abcdef xyz long", "xyz lo 2", "xyz lo", "Xyz, lo", "abcdef", "abcdef xyz", "night", "late night", "a", "", "late night show"]
    for _ in range(300):
        events = [(i, rng.choice(texts) + rng.choice(["", "", "!", " 2"]), rng.randrange(3)) for i in range(rng.randrange(1, 25))]
        got = L.greedy_dedup([e[1] for e in events], [e[2] for e in events])
        assert dict(enumerate(got)) == literal_dedup(events), events


def test_chunks_of_a_table_in_parts_of_a_batch(spark):
    rng = random.Random(8)
    texts = [rng.choice([None, "", "x" * rng.randrange(400_000), "a\n\nb\n## c\n" * rng.randrange(900), "é" * 2_500]) for _ in range(60)]
    rows = [(None if i % 7 == 0 else f"k{i}", t) for i, t in enumerate(texts)]
    out = L.chunk(spark.createDataFrame(rows, "key string, body string").coalesce(1), "key", "body", 2_000)
    assert out.dtypes == [("key", "string"), ("chunk_no", "int"), ("chunk", "string")]
    assert [tuple(r) for r in out.collect()] == [(k, i, c) for k, t in rows if t for i, c in enumerate(L.cut_chunks(t, 2_000))]
    assert "MapInPandas" not in out._jdf.queryExecution().toString()


def test_chunks_are_slices_of_the_text():
    assert L.cut_chunks("  a\n\nb  \n", 100) == ["  a\n\nb  \n"]
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", "\n", "\n\n", "\n## h", "\n### i"]) for _ in range(rng.randrange(200)))
        assert "".join(L.cut_chunks(text, 40)) == text
        with_overlap = L.cut_chunks(text, 40, 50)  # no step back past a piece's own start
        assert "".join(with_overlap) == text and all(len(c) <= 40 for c in with_overlap)


def test_fuzzy_match_with_one_shared_beginning(spark):
    places = spark.createDataFrame([(i, f"museum of {i:04d}", None, None, float(i), 0.0, "x") for i in range(2000)], "pos int, name string, short_name string, alternate_names array<string>, lat double, lng double, emoji string")
    rows = spark.createDataFrame([(i, f"the museum of {i:04d} annex", "", "e") for i in range(2000)], "id int, location string, sublocation string, name string")
    got = L.match_fuzzy(L.search_keys(rows), L.gazetteer(places), "id").collect()
    assert {r["id"]: r["place"]["lat"] for r in got} == {i: float(i) for i in range(2000)}


def test_alike_strings_against_all_pairs(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(150)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        return new

    want = {(a, b) for a in words for b in words if (len(a) + len(b) - edits(a, b)) / (len(a) + len(b)) >= 0.85}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = L.alike_strings(df.toDF("a"), df.toDF("b"), "a", "b", 0.85).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_emphasis_against_a_plain_rule(spark):
    import re

    from whenwhere.functions import text

    rng = random.Random(8)
    rows = [("".join(rng.choice(["*", "**", "_", "__", "a", "b", " ", "é"]) for _ in range(rng.randrange(20))),) for _ in range(200)]
    plain = lambda t: re.sub(r"\b_(.*?)_\b", r"<em>\1</em>", re.sub(r"\*(.*?)\*", r"<em>\1</em>", re.sub(r"\b__(.*?)__\b", r"<strong>\1</strong>", re.sub(r"\*\*(.*?)\*\*", r"<strong>\1</strong>", t))))
    for r in spark.createDataFrame(rows, "t string").select("t", text.emphasise(F.col("t")).alias("e")).collect():
        assert r["e"] == plain(r["t"])


def test_stages_stop_at_the_first_failure():
    from whenwhere.plans import batch

    ran = []

    def bad():
        raise OSError("store")

    assert batch.run_stages([("a", lambda: ran.append("a"))]) == ["a"]
    with pytest.raises(RuntimeError, match="stage b failed after a"):
        batch.run_stages([("a", lambda: ran.append("a")), ("b", bad), ("c", lambda: ran.append("c"))])
    assert ran == ["a", "a"]


def test_batch_from_pages_to_export(spark, tmp_path):
    from whenwhere.functions.tags import TagRules
    from whenwhere.plans import batch

    line = "| {} | Harbor Hall |  | 2025-10-04 | 7pm |  |  | desc | https://e.org/{} | #A | x |"
    body = "| " + " | ".join(L.HEADER) + " |\n|---|\n" + "\n".join([line.format("Jazz evening", 1), line.format("Jazz evening!", 2), line.format("Poetry", 3)])
    pages = spark.createDataFrame([("f1", None, body), ("f2", None, body.replace("/1", "/9"))], "file string, extra_tags array<string>, body string")
    places = spark.createDataFrame([(0, "Harbor Hall", "Hall", None, 40.7, -74.0, "h")], "pos int, name string, short_name string, alternate_names array<string>, lat double, lng double, emoji string")
    done = batch.run(pages, places, TagRules(), F.lit("2025-10-01").cast("date"), str(tmp_path))
    assert done.stages == ["process", "place", "group", "export"]
    assert done.report() == {"pages read": 2, "rows read": 6, "rows dropped": 0, "rows without a place": 0, "rows merged into events": 2, "events not exportable": 0, "events merged": 2, "events exported": 2}
    got = {r["name"]: r["urls"] for r in spark.read.json(f"{tmp_path}/events.init", multiLine=True).collect()}
    assert got == {"Jazz evening": ["https://e.org/1", "https://e.org/2", "https://e.org/9"], "Poetry": ["https://e.org/3"]}


def test_settings_files(spark, tmp_path):
    from whenwhere.sources import files

    (tmp_path / "related.json").write_text('{"Art": [["Gallery", 0.5]]}')
    (tmp_path / "tags.json").write_text('{"geotags": ["Queens"], "bgcolors": {"x": "#1"}, "remove": ["kids"]}')
    (tmp_path / "broken.json").write_text("{")
    assert [tuple(r) for r in files.read_related(spark, f"{tmp_path}/related.json").collect()] == [("Art", "Gallery", 0.5)]
    assert files.read_related(spark, f"{tmp_path}/none.json").count() == 0
    assert files.read_tag_display(spark, f"{tmp_path}/tags.json") == (("queens",), {"x": "#1"})
    assert files.read_tag_rules(spark, f"{tmp_path}/tags.json").remove == ("kids",)
    assert files.read_tag_rules(spark, f"{tmp_path}/broken.json") == files.TagRules()
    links = spark.createDataFrame([("s", f"https://s/event/{i}", "event, show") for i in range(5)] + [("t", "https://t/event", "show"), ("t", "https://t/show", "show")], "site string, url string, keywords string")
    assert sorted(r["url"] for r in files.follow_keywords(links, "site", "url", "keywords", 2).collect()) == ["https://s/event/0", "https://s/event/1", "https://t/show"]


def test_view_pieces(spark):
    from whenwhere.operators import view as V
    from whenwhere.operators.session import Session

    events = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 6, "c"), (3, 7, "d")], "id int, loc_id int, name string")
    shown = events.where("id = 1")
    assert sorted(r["id"] for r in V.with_forced(shown, events.where("id < 3"), 2).collect()) == [1, 2]
    assert V.with_forced(shown, events, 1).count() == 1
    assert {r["id"]: r["name"] for r in V.last_by_id(events, "loc_id").collect()}[3] == "d"
    assert V.envelope([(1.0, 4.0), (3.0, 2.0)]) == ((1.0, 2.0), (3.0, 4.0))
    s = Session(related=lambda t: [("near", 0.5)] if t in ("x", "y") else [])
    s.click("x")
    assert s.exclude("near") and not s.exclude("x") and "near" not in s.chosen
    s.click("y")
    s.click("x")
    assert "near" not in s.chosen
    s.clear_excluded()
    s.click("y")
    s.click("x")
    assert s.chosen["near"][1] == 0.5


def test_a_batch_that_fails_on_its_way_is_there_once(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    root, schema = f"file://{tmp_path}/t", "k long, v string"
    land = lambda a, b: spark.range(a, b, 1, 3).select(F.col("id").alias("k"), F.lit("x").alias("v")).write.mode("append").parquet(f"{tmp_path}/in")
    from pyspark.sql.types import _parse_datatype_string

    stream = lambda: incremental.arrivals(spark, f"{tmp_path}/in", _parse_datatype_string(schema), 2)
    land(0, 30)

    def broken(spark_, root_, batch):
        if batch == 1:
            raise RuntimeError("lost between the rows and the log")
        incremental._note(spark_, root_, batch)

    with pytest.raises(StreamingQueryException):
        incremental.append_batches(stream(), root, broken)
    seen = {r["k"]: r["id"] for r in incremental.appended(spark, root).collect()}
    assert 0 < len(seen) < 30
    incremental.append_batches(stream(), root)
    land(30, 60)
    incremental.append_batches(stream(), root)
    rows = incremental.appended(spark, root).collect()
    assert sorted(r["k"] for r in rows) == list(range(60)) and len({r["id"] for r in rows}) == 60
    assert all(r["id"] == seen[r["k"]] for r in rows if r["k"] in seen)
    assert max(r["id"] for r in rows if r["k"] < 30) < min(r["id"] for r in rows if r["k"] >= 30)
    incremental.append_batches(stream(), root)
    assert incremental.appended(spark, root).count() == 60


def test_section_order_as_dismissals_say(spark):
    rows = [(1, "b", 3), (1, "a", 5), (1, "b", 9), (1, "zz", 10), (1, None, 11), (2, "c", 4), (2, "a", 4), (3, "x", 1), (4, "a", None)]
    got = {r["u"]: r["sections"] for r in V.section_order(spark.createDataFrame(rows, "u long, s string, at long"), "u", "s", "at", ("a", "b", "c")).collect()}
    assert got == {1: ["c", "a", "b"], 2: ["b", "a", "c"], 3: ["a", "b", "c"], 4: ["a", "b", "c"]}


def test_prompts_and_tables(spark):
    from whenwhere.plans import extract

    pages = spark.createDataFrame([("20250101", "a_b", "http://u", "see {url} {x}"), ("20250101", "c", None, "no address"), ("20250102", "d", "http://d", None), ("20250102", "e", "http://e", "done")], "crawl_date string, site string, source_url string, body string")
    todo = extract.pending(pages, spark.createDataFrame([("20250102", "e"), ("20250102", "a_b")], "crawl_date string, site string"))
    notes = spark.createDataFrame([("a_b", "n2"), ("a_b", "n1")], "site string, notes string")
    got = {r["site"]: r["prompt"] for r in extract.prompts(todo, "{name}|{url}|{content}|{date}|{notes}|{y}", notes).collect()}
    assert got == {"a_b": "A B|http://u|see {url} {x}|2025-01-01|n1|{y}", "d": "D|http://d||2025-01-02||{y}"}
    answers = spark.createDataFrame([("20250101", "a_b", 1, extract.HEAD + "\n| 2 |"), ("20250101", "a_b", 0, extract.HEAD + "\n| 1 |"), ("20250102", "d", 0, "  "), ("20250102", "e", 0, "x"), ("20250101", "a_b", 2, None)], "crawl_date string, site string, chunk_no int, text string")
    made = {r["site"]: r["body"] for r in extract.tables(todo, answers).collect()}
    assert made == {"a_b": extract.HEAD + "\n| 1 |\n| 2 |", "d": extract.HEAD}
