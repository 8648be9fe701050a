import datetime as dt
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from whenwhere.functions import geo, tags, text, url, when


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("given", "wanted", "f"),
    [
        ("A<br>B&nbsp;&amp;  C", "A B & C", text.sanitize),
        ("a&amp;lt;b​\tc", "a<b c", text.sanitize),
        (None, None, text.sanitize),
        ("BAKER-JOHN'S 38TH", "Baker-John's 38th", text.recapitalise),
        ("DJ AND TV NIGHT II W/ 35MM", "DJ and TV Night II w/ 35mm", text.recapitalise),
        ("ABCDE", "ABCDE", text.recapitalise),
        ("12345678", "12345678", text.recapitalise),
        ("Concert: Ann (Early Show) w/ Bob", "Ann", text.short_name),
        ("Film Night at the Old Harbor Society: A Long Movie", "A Long Movie", text.short_name),
        ("Talk - Q&A with Ann", "Q&A", text.short_name),
        ("Jazz @ Hall", "Jazz", text.short_name),
        ("The Metropolitan Museum of Art, New York", "metropolitan museum of art", text.normal_place),
        ("Apollo - Brooklyn", "apollo brooklyn", text.normal_place),
        ("Brooklyn", "", text.normal_place),
        ("Virtual", "", text.normal_place),
        (None, "", text.normal_place),
        ("_Ünder_score,  Party! ", "ünderscore party", text.normal_name),
        ("a" * 41, "a" * 35 + "…", lambda c: text.display_name(F.lit(""), c)),
        ("3 🎭", "3", text.first_emoji),
        ("go 👩‍🎨!", "👩‍🎨", text.first_emoji),
        ("none", None, text.first_emoji),
        ("Élan", "elan", text.search_form),
        ("<a&'", "&lt;a&amp;&#039;", text.escape_html),
        ("**b** and *i*", "<strong>b</strong> and <em>i</em>", text.emphasise),
        ("N/A for now", "", text.blank_if_missing),
        ("https://Example.org:80/x", "example.org", text.host_of),
        ("6:30 p.m.", "6:30pm", when.standard_time),
        ("7:00 PM", "7pm", when.standard_time),
        ("All Day", "", when.standard_time),
    ],
)
def test_text(spark, given, wanted, f):
    assert one(spark, given, f) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("7pm", 1140), ("12am", 0), ("12pm", 720), ("noon", 720), ("", 720), (None, 720), ("6:30 PM", 1110)])
def test_minutes(spark, given, wanted):
    assert one(spark, given, when.minutes_of) == wanted


RULES = tags.TagRules({"qanda": "Q&A", "livemusic": "Music", "kpop": "K-Pop"}, ("nyc",), ("gone",))


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("#LatinJazz", ["Latin Jazz"]), ("#Catch22", ["Catch 22"]), ("#McPherson #StJames", ["McPherson", "St. James"]), ("#10KRun #3DPrinting", ["10K Run", "3D Printing"]),
        ("#QAndA, #KPop", ["Q&A", "K-Pop"]), ("#NYC", []), ("#LiveMusic #Music", ["Music"]), ("#FoodAndDrink", ["Food and Drink"]), ("#OBrien", ["O'Brien"]), (None, []), ("# #", []),
    ],
)
def test_tags(spark, given, wanted):
    assert one(spark, given, lambda c: tags.process(c, RULES)) == wanted


def test_extra_tags_come_first_and_are_not_rewritten(spark):
    assert one(spark, "#Music #KPop", lambda c: tags.process(c, RULES, F.array(F.lit("KPop"), F.lit("NYC")))) == ["KPop", "Music", "K-Pop"]
    assert one(spark, "#Gone", lambda c: tags.keeps(tags.process(c, RULES), RULES)) is False
    assert one(spark, "Online", lambda c: tags.with_virtual(F.array(F.lit("A")), c)) == ["A", "Virtual"]


@pytest.mark.parametrize(("day", "minutes", "wanted"), [("2025-07-04", 1140, "2025-07-04 23:00"), ("2025-12-01", 720, "2025-12-01 17:00"), ("2025-03-09", 60, "2025-03-09 05:00")])
def test_instant(spark, day, minutes, wanted):
    got = one(spark, day, lambda c: when.local_instant(when.strict_date(c), F.lit(minutes)).cast("string"))
    assert got.startswith(wanted)


@pytest.mark.parametrize(
    ("start", "end", "wanted"),
    [("2025-10-04", "", True), ("2025-9-1", None, False), ("2025-9-1", "2025-10-01", True), ("2025-13-01", "", False), ("2026-01-01", "", False), ("2025-10-02", "2026-11-07", False), (None, None, False)],
)
def test_reach(spark, start, end, wanted):
    row = spark.createDataFrame([(start, end)], "s string, e string")
    assert row.select(when.within_reach(F.col("s"), F.col("e"), F.lit(dt.date(2025, 10, 1)))).first()[0] is wanted


def test_geo(spark):
    row = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, "kitten", "sitting")], "a double, b double, c double, d double, k string, s string")
    got = row.select(geo.distance_m(*map(F.col, "abcd")), geo.edit_ratio(F.col("k"), F.col("s")), geo.in_quad(F.lit(0.5), F.lit(0.5), [(0, 0), (0, 1), (1, 1), (1, 0)]), geo.in_quad(F.lit(1.5), F.lit(0.5), [(0, 0), (0, 1), (1, 1), (1, 0)])).first()
    assert round(got[0], 2) == 111194.93
    assert got[1] == pytest.approx(10 / 13)
    assert got[2] is True
    assert got[3] is False


def test_view_state(spark):
    got = spark.createDataFrame([("https://x/?lat=40.5abc&lng=500&zoom=25&start=1999-01-01&end=2024-02-30&tags=A%20B,%3Cx%3E,C-d",), ("https://x/",)], "u string").select(*(v.alias(k) for k, v in url.view_state(F.col("u")).items())).collect()
    assert tuple(got[0]) == (40.5, None, None, None, None, ["A B", "C-d"])
    assert tuple(got[1]) == (None, None, None, None, None, [])


def test_decode_html(spark):
    rows = [("a &amp; b", "a & b"), ("&lt;i&gt;&#39;&#x27;&quot;", "<i>''\""), ("&eacute;t&eacute;", "été"), ("&amp;lt;", "&lt;"), ("no entity &zzz;", "no entity &zzz;"), ("&nothing;", "¬hing;"), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").select(text.decode_html(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


@pytest.mark.parametrize("given, wanted", [("2024-2-29", "2024-02-29"), ("2023-2-29", None), ("0000-01-01", None), ("2024-01-01\n", None), (" 2024-01-01", None), ("2024-01", None), ("2024-01-01T10", None), ("24-1-1", None), (None, None)])
def test_dates_are_strict(spark, given, wanted):
    assert one(spark, given, lambda c: when.strict_date(c).cast("string")) == wanted


def test_an_expression_is_worked_out_once_for_all_tags_and_dates(spark):
    """How often the plan names an expression is how often a lambda works it out for each element."""
    from whenwhere.plans.view import parsed_occurrences

    rows = spark.createDataFrame([("#A", [("2024-01-01", "7pm", "", "")])], "t string, o array<struct<start_date string, start_time string, end_date string, end_time string>>")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tags.process(F.col("t"), RULES)).count("split(") == 1
    assert plan(parsed_occurrences(F.col("o"))).count("(?!0000)") == 2  # a start and an end


def old_form(t):
    return "".join(c for c in unicodedata.normalize("NFD", t) if not "\u0300" <= c <= "\u036f").lower()


ODD = ["", "Plain ASCII", "ÉÈ Å", "İI ΑΣ ΟΔΟΣ", "한글 가", "が プ", "a\u0323\u0307\u0599", "\u0301", "\U0001D15E", "\uFB01 \u212B", "й\u0488"]


def test_search_forms_are_those_of_the_plain_rule(spark):
    rng = random.Random(4)
    texts = [rng.choice([None, *ODD, "É" * rng.randrange(60_000), "x" * rng.randrange(3_000)]) for _ in range(800)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1).select("i", text.search_form(F.col("t")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in got} == {i: None if t is None else old_form(t) for i, t in enumerate(texts)}


def test_a_batch_of_texts_is_worked_on_in_parts():
    """Only a part of an Arrow batch is ever made into Python strings; all rows come back, in order."""
    texts = ["é" * n for n in (10, 400_000, 0, 700_000, 5, 3_000_000, 1)] + [None] * 5 + ["a" * 300_000] * 9
    for batch in (pa.array(texts, pa.string()), pa.array([*texts, "cut off"], pa.string()).slice(0, len(texts)), pa.array(["before", *texts], pa.string()).slice(1)):
        parts = list(text.search_form.func(iter([batch])))
        assert [t for p in parts for t in p.to_pylist()] == [None if t is None else old_form(t) for t in texts]
        at = 0
        for part in parts:
            sizes = [len((x or "").encode()) for x in texts[at : at + len(part)]]
            assert sum(sizes) - max(sizes) <= text.PART_BYTES
            at += len(part)
    assert list(text.search_form.func(iter([pa.array([], pa.string())]))) == []


@pytest.mark.parametrize(("f", "given", "wanted"), [("decode_html", "a &amp; &eacute;" + "&lt;" * 100_000, "a & é" + "<" * 100_000), ("first_emoji", "x" * 400_000 + "\U0001F600", "\U0001F600")])
def test_pages_and_emoji_are_worked_on_in_parts(f, given, wanted):
    batch = pa.array([given, None, "", given] * 4, pa.string())
    parts = list(getattr(text, f).func(iter([batch])))
    assert len(parts) > 2 and [t for p in parts for t in p.to_pylist()] == [wanted, None, "" if f == "decode_html" else None, wanted] * 4
