"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one document. The method counts, for each host, the distinct documents that hold a line (hashed after
lower-casing, turning digits into 0 and squeezing white space), drops lines above the host's limit, and rejects documents
that keep too little. With ``keep_first`` a line stays in its first document (least id), for corpora whose near copies are
still to be deduplicated. Documents with equal texts are one document for these counts. A line's limit is ``max(min_docs, share * documents of the host)``: it grows with the host and
means the same at any size.

Texts are read once: their base counts and the hashes of their lines are written, and all else works on these, unless texts are asked for.
Lines are exploded for the counts, with partial sums before the shuffles; only lines above ``min_docs`` come back to the documents. Texts are
shuffled only if they are asked for.

Defined results: a null text has no words: its counts are 0 and it fails the base rules. A null host is a host of its
own. Blank lines are never counted. Rows with a null or repeated doc_id are judged each by its own text; a null id is never
a line's first document. An empty table gives no rows. Columns that clash with a result's name are replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

MIN_DOCS, SHARE, LEAST_KEPT, MIN_WORDS, REPEAT_PERCENT = 20, 0.005, 0.3, 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs outside [\\x20\\x09-\\x0D]."""
    t = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.filter(F.split(t, " "), lambda w: w != "")


def without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(rows: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words in 3-word windows found twice or more in the row.

    Only rows with a repeated window sort their windows, by (fingerprint, place); equal neighbours give the places.
    """
    n = F.size(words)
    rows = rows.withColumn("_h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_p", F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))))
    again = F.filter("_p", lambda x, i: (F.coalesce(F.get(F.col("_p"), i - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(F.col("_p"), i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda s, x: s + x
    )
    return rows.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_p", "_at")


def base_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumn("_w", words_of(F.col(text_col))).withColumn("_l", lines)
    rows = rows.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.octet_length(t) - F.octet_length(without(t, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
    })
    rows = repeated_words(rows, "_w", "n_repeat_words").drop("_w", "_l")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")


def line_keys(text: Column, host: Column) -> Column:
    """One (key, words, line) for each \\n-split line; a blank line's key is null."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x: F.struct(F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(F.coalesce(host, F.lit("\0")), normal_line(x))).alias("key"), F.size(words_of(x)).alias("n"), x.alias("line")))


def frequent_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """(key, n_docs, first_id) of lines in more than ``min_docs`` distinct documents; docs has own, ver and keys."""
    keys = docs.select("own", "ver", F.explode(F.array_distinct(F.filter(F.transform("keys", lambda x: x["key"]), lambda k: k.isNotNull()))).alias("key"))
    once = keys.groupBy("key", "ver").agg(F.min("own").alias("own"))
    return once.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("own").alias("first_id")).where(F.col("n_docs") > min_docs)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, least_kept: float = LEAST_KEPT, keep_first: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, n_frequent_words (in dropped lines), kept.

    ``keep`` names columns of the input to return too; with the text among them, kept_text (the text without the dropped lines) comes in its place.
    """
    with_text = text_col in keep
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))
    rows = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("_text"), host.alias("host"), F.xxhash64(text_col).alias("ver"), *(F.col(c).alias(f"_keep_{c}") for c in keep if c != text_col))
    keyed = rows.withColumn("keys", line_keys(F.col("_text"), F.col("host")))
    counted = base_counts(keyed, "_text")
    lines = F.col("keys") if with_text else F.transform("keys", lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n")))
    counted = counted.withColumn("keys", lines).withColumn("_null", F.col("_text").isNull()).drop("_text")
    if not with_text:  # texts are read and their lines hashed once
        counted = keyed = materialise(counted, "lines")
    hosts = keyed.groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = frequent_lines(keyed.select("own", "ver", "keys"), min_docs)
    seen = keyed.select("own", "ver", "host", F.explode(F.array_distinct(F.transform("keys", lambda x: x["key"]))).alias("key")).join(frequent, "key")
    if keep_first:
        seen = seen.where("own is null or own <> first_id")
    seen = seen.groupBy("own", "ver", "host").agg(F.collect_set(F.struct("key", "n_docs")).alias("seen"))
    joined = counted.alias("c").join(seen.alias("s"), F.col("c.own").eqNullSafe(F.col("s.own")) & (F.col("c.ver") == F.col("s.ver")) & (F.col("c.host") == F.col("s.host")), "left").select("c.*", "s.seen").join(hosts, "host", "left")
    limit = F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("host_docs"))
    joined = joined.withColumn("_limit", limit).withColumn("_gone", F.transform(F.filter(F.coalesce("seen", F.array().cast("array<struct<key:bigint,n_docs:bigint>>")), lambda x: x["n_docs"] > F.col("_limit")), lambda x: x["key"]))
    # the lines are searched only where something is dropped
    joined = joined.withColumn("n_frequent_words", F.when(F.size("_gone") > 0, F.aggregate(F.filter("keys", lambda x: F.array_contains("_gone", F.coalesce(x["key"], F.lit(0))) & x["key"].isNotNull()), F.lit(0), lambda s, x: s + x["n"])).otherwise(0).cast("long"))
    # one comparison over both sides of the join: a filter on it stays above the join, where the base counts are columns already
    kept = F.when(F.col("base_failed"), F.lit(-1).cast("long")).otherwise(F.col("n_words") - F.col("n_frequent_words")) >= F.lit(least_kept) * F.col("n_words")
    out = [F.col("own").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_frequent_words"]
    out += [F.col(f"_keep_{c}").alias(c) for c in keep if c not in (text_col, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words", "kept_text")]
    if with_text:
        left = F.filter("keys", lambda x: x["key"].isNull() | ~F.array_contains("_gone", F.coalesce(x["key"], F.lit(0))))
        left = F.when(F.size("_gone") > 0, left).otherwise(F.col("keys"))
        out.append(F.when(~F.col("_null"), F.array_join(F.transform(left, lambda x: x["line"]), "\n")).alias("kept_text"))
    return joined.select(*out)


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, chr(1)) as host,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
tri as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i+1], w[i+2]) as c from win),
rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from tri where c > 1) group by 1),
ln as (select doc_id, host, text, line, pos, regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') as norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from (select doc_id, host, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct line) as n from ln group by 1),
hosts as (select host, count(*) as host_docs from d group by 1),
freq as (select host, norm, count(distinct text) as n_docs from ln group by 1, 2),
gone as (select l.doc_id, sum(l.n) as n from ln l join freq f on l.host = f.host and l.norm = f.norm join hosts h on l.host = h.host
  where f.n_docs > greatest({float(MIN_DOCS)}, {SHARE} * h.host_docs) group by 1),
b as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
    cast(coalesce(gone.n, 0) as bigint) as n_frequent_words
  from d left join dup using (doc_id) left join rep using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) and n_words - n_frequent_words >= {LEAST_KEPT} * n_words as kept,
  n_frequent_words
from b
"""
