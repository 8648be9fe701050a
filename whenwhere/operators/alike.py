"""Names that are alike, and the greedy choices over them, as joins and rounds.

Two plain names are alike if they are equal or, from five characters on, one is in the other. A page or place may have any number of names, so
no task gets all of one. The names of a page of up to FEW are paired off within it, so a character is looked at FEW times at most. In larger pages alike
names meet without pairing off the page: a name of up to SHORT characters is looked for among the whole substrings of that length of the
others, a longer one where its rarest run of SHORT characters in the page stands; then the names themselves decide.

Greedy groups: in order, a name joins the first name that opened a group and is alike, else it opens one. That is the lexicographically first
independent set of the graph of alike names, so names settle in rounds: those without an earlier candidate open groups; what is alike to an
opener is out; names whose earlier candidates are all out open groups in the next round. There are as many rounds as the longest chain of names that wait for
each other, each over what has not settled.

Where a group's name changes as it grows (``dedup``), only names of one connected component ever meet; components are what is dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import staged

SHORT, LEAST = 16, 5
#: A page whose names are paired off has so many names, and that costs so many comparisons of characters, at most; beyond that its names meet by runs.
FEW, LOOKS = 1 << 10, 1 << 30
#: White space as names are stripped of it: that of Unicode, and four separators.
BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def plain_name(name: Column) -> Column:
    """Lower case letters, digits and single blanks; null as empty."""
    bare = F.regexp_replace(F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("_"), F.lit(""))), rf"[^\p{{L}}\p{{N}}{BLANK}]", "")
    return F.trim(F.regexp_replace(bare, rf"[{BLANK}]+", " "))


def _runs(text: Column, size: Column) -> Column:
    """Fingerprints of all substrings of a size, in one pass over a text."""
    every = F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1))
    return F.transform(every, lambda run: F.xxhash64(run))


def alike(nodes: DataFrame, by: list[str], few: int = FEW, looks: int = LOOKS) -> DataFrame:
    """(by, u, v), u < v: the places (at) of distinct plain names of one page or place that are in one another."""
    able = nodes.where(F.length("plain") >= LEAST).select(*by, "plain", "at")
    pages = able.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.length("plain").cast("long")).alias("letters"), F.collect_set(F.when(F.length("plain") <= SHORT, F.length("plain"))).alias("sizes"))
    pages = pages.where("n > 1").select(*by, "sizes", ((F.col("n") > few) | (F.col("n") * F.col("letters") > looks)).alias("crowded"))
    # few names may be long: they are spread before they are compared
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    able = staged(able.join(pages, by).repartition(spread, *by, "plain"), "names")
    rest, crowded = able.where(~F.col("crowded")), able.where("crowded")
    met = rest.select(*by, "at", "plain").join(rest.select(*by, F.col("at").alias("q_at"), F.col("plain").alias("q")), by)
    if not crowded.isEmpty():
        met = met.unionByName(_met(crowded, by))
    met = met.where((F.length("q") < F.length("plain")) & F.contains("plain", F.col("q")))
    return met.select(*by, F.least("at", "q_at").alias("u"), F.greatest("at", "q_at").alias("v")).distinct()


def _met(able: DataFrame, by: list[str]) -> DataFrame:
    """(by, q_at, at, plain, q) of the names of large pages that may be in one another: they share a run."""
    # short names among the substrings of the lengths that short names of the page have
    fitting = F.filter("sizes", lambda n: n < F.length("plain"))
    parts = able.select(*by, "at", F.explode(F.array_distinct(F.flatten(F.transform(fitting, lambda n: _runs(F.col("plain"), n))))).alias("run"))
    short = able.where(F.length("plain") <= SHORT).select(*by, F.col("at").alias("q_at"), F.xxhash64("plain").alias("run"))
    # longer ones by their rarest run
    grams = staged(able.where(F.length("plain") > SHORT).select(*by, "at", F.explode(F.array_distinct(_runs(F.col("plain"), F.lit(SHORT)))).alias("run")), "runs")
    often = grams.groupBy(*by, "run").agg(F.count("*").alias("often"))
    rarest = grams.join(often, [*by, "run"]).groupBy(*by, "at").agg(F.min(F.struct("often", "run")).alias("r"))
    anchors = rarest.where("r.often > 1").select(*by, F.col("at").alias("q_at"), F.col("r.run").alias("run"))
    met = short.join(parts, [*by, "run"]).unionByName(anchors.join(grams, [*by, "run"])).where("at <> q_at").select(*by, "q_at", "at").distinct()
    return met.join(able.select(*by, "at", "plain"), [*by, "at"]).join(able.select(*by, F.col("at").alias("q_at"), F.col("plain").alias("q")), [*by, "q_at"])


def first_openers(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, at, key_at) of the names that join an earlier one: the first opener that is alike. Names that are not returned open a group."""
    edges = staged(edges, "alike")
    live, openers = edges, None
    fresh = edges.select(*by, F.col("u").alias("at")).distinct().join(edges.select(*by, F.col("v").alias("at")), [*by, "at"], "left_anti")
    while not live.isEmpty():
        fresh = staged(fresh, "openers")
        openers = fresh if openers is None else openers.unionByName(fresh)
        out = staged(live.join(fresh.withColumnRenamed("at", "u"), [*by, "u"], "left_semi").select(*by, F.col("v").alias("at")).distinct(), "joined")
        waiting = live.select(*by, F.col("v").alias("at")).distinct().join(out, [*by, "at"], "left_anti")
        live = staged(live.join(out.withColumnRenamed("at", "v"), [*by, "v"], "left_anti").join(out.withColumnRenamed("at", "u"), [*by, "u"], "left_anti"), "live")
        fresh = waiting.join(live.select(*by, F.col("v").alias("at")), [*by, "at"], "left_anti")
    if openers is None:
        return edges.select(*by, F.col("v").alias("at"), F.col("u").alias("key_at"))
    return edges.join(openers.withColumnRenamed("at", "u"), [*by, "u"]).groupBy(*by, F.col("v").alias("at")).agg(F.min("u").alias("key_at"))


def spot(*columns: Column) -> Column:
    """One key for a page or place and day: equal values, nulls among them, are equal keys."""
    return F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\0")) for c in columns))


def group(rows: DataFrame, page: str, order: str, name: str = "name") -> DataFrame:
    """(page, order, key_at): for each row the order of the row that opened its group. ``order`` numbers the rows of a page."""
    keyed = rows.select(page, spot(F.col(page)).alias("_spot"), F.col(order).cast("long").alias(order), plain_name(F.col(name)).alias("plain"))
    nodes = staged(keyed.groupBy("_spot", "plain").agg(F.min(order).alias("at")), "nodes")
    joined = first_openers(alike(nodes, ["_spot"]), ["_spot"])
    of = nodes.join(joined, ["_spot", "at"], "left").select("_spot", "plain", F.coalesce("key_at", "at").alias("key_at"))
    return keyed.join(of, ["_spot", "plain"]).select(page, order, "key_at")


def components(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, at, part): the least place of the connected component of each name that is in a pair; labels halve their way by pointing at labels."""
    edges = staged(edges, "alike")
    both = edges.select(*by, F.col("u").alias("at"), F.col("v").alias("to")).unionByName(edges.select(*by, F.col("v").alias("at"), F.col("u").alias("to")))
    both = staged(both, "links")
    label = staged(both.groupBy(*by, "at").agg(F.least(F.col("at"), F.min("to")).alias("part")), "labels")
    while True:
        # the least label of a name's neighbours, then the label of that
        near = both.join(label.withColumnRenamed("at", "to"), [*by, "to"]).groupBy(*by, "at").agg(F.min("part").alias("near"))
        low = label.join(near, [*by, "at"]).select(*by, "at", F.least("part", "near").alias("part"), F.col("part").alias("was"))
        jump = label.select(*by, F.col("at").alias("part"), F.col("part").alias("far"))
        low = staged(low.join(jump, [*by, "part"], "left").select(*by, "at", F.least("part", F.coalesce("far", "part")).alias("part"), "was"), "labels")
        label = low.drop("was")
        if low.where("part <> was").isEmpty():
            return label

