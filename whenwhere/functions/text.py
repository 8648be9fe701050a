"""Text functions over event listings, as Column expressions."""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entities in the order in which they are replaced.
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&rdquo;", '"'), ("&ldquo;", '"'),
]
#: Invisible characters that are dropped.
INVISIBLE = r"\x{200B}\x{200C}\x{FEFF}\x{00AD}"
#: Words that stay lower case inside a title or tag.
CONNECTORS = ["A", "And", "Of", "The", "Or", "In", "At", "On", "For", "To", "With", "From", "By"]
#: Numerals that stay in capitals.
ROMAN = ["I", "Ii", "Iii", "Iv", "V", "Vi", "Vii", "Viii", "Ix", "X", "Xi", "Xii"]
#: Place suffixes, in the order in which they are tried, and the parts of town.
PLACE_SUFFIXES = ["nyc", "new york", "brooklyn", "manhattan", "queens", "bronx", "staten island"]
BOROUGHS = ["queens", "bronx", "brooklyn", "manhattan", "staten island"]
#: Kinds of event that may precede a name.
NAME_PREFIXES = [r"^Exhibition\s*[–:\-]\s*", r"^Talks?\s*[:\-]\s*", r"^Screening\s*[:\-]\s*", r"^Performance\s*[:\-]\s*", r"^Concert\s*[:\-]\s*", r"^Event\s*[:\-]\s*"]
#: Beginnings of the names of cancelled events.
CANCELLED = ["CANCELED:", "CANCELLED:", "KIM:", "KIM -"]
#: So many bytes of texts, or one text, are Python strings at a time.
PART_BYTES = 1 << 20
#: Combining marks that a search form drops.
MARKS = re.compile("[\u0300-\u036f]+")


def fold(column: Column, *steps: tuple[str, str]) -> Column:
    """Regular replacements one after the other."""
    for pattern, to in steps:
        column = F.regexp_replace(column, pattern, to)
    return column


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sanitize(text: Column) -> Column:
    """Plain text of a snippet of HTML: tags to blanks, common entities decoded in order, white space squeezed."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(F.regexp_replace(out, f"[{INVISIBLE}]", ""))


def short_name(name: Column) -> Column:
    """A name without kinds, long titles before a colon, brackets, performers, venues and weekday ranges."""
    out = fold(name, *((f"(?iU){p}", "") for p in NAME_PREFIXES))
    after = squeeze_ends(F.regexp_replace(out, r"(?s)^[^:]*:", ""))
    out = F.when((F.length(out) > 40) & F.contains(out, F.lit(":")) & (F.length(after) > 3), after).otherwise(out)
    out = F.when(F.length(out) > 40, F.regexp_replace(out, r"(?U)\s+[–\-]\s+.*$", "")).otherwise(out)
    return squeeze(
        fold(
            out,
            (r"(?U)\s*\([^)]*\)", ""),
            (r"(?U)\s*[-–]\s*Q&A\s+with\s+.*$", ""),
            (r"(?U)\s*\\?\s*\|\s*with\s+.*$", ""),
            (r"(?U)\s+w/\s+.*$", ""),
            (r"(?iU)\s+with\s+.*$", ""),
            (r"(?iU)\s+at\s+.*$", ""),
            (r"(?U)\s*@.*$", ""),
            (r"(?U)\s+in\s+NYC\s*[-–].*$", ""),
            # fixed values: the days of the week
            (r"(?U)\s*[-–]\s*(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+.*$", ""),
        )
    )


def squeeze_ends(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first; other characters as they are."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2**31 - 1)))), "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spread(rows):
    """The rows over all cores. Few bytes are few splits, however many rows and however dear the work on each."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def where_found(text: Column, pattern: str, change) -> Column:
    """``change(text)`` where the pattern occurs, else the text as it is; one look instead of many replacements."""
    return let(text, lambda t: F.when(t.rlike(pattern), change(t)).otherwise(t))


def lower_connectors(text: Column) -> Column:
    return where_found(text, rf"(?U)(?<!^)\b(?:{'|'.join(CONNECTORS)})\b", lambda t: fold(t, *((rf"(?U)(?<!^)\b{w}\b", w.lower()) for w in CONNECTORS)))


def lower_ordinals(text: Column) -> Column:
    return where_found(text, r"(?U)\d(?:St|Nd|Rd|Th)\b", lambda t: fold(t, *((rf"(?U)(\d+){s}\b", f"$1{s.lower()}") for s in ("St", "Nd", "Rd", "Th"))))


def recapitalise(name: Column) -> Column:
    """Names of over five characters that are mostly capitals, in title case with the usual exceptions."""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(name, r"[^\p{Lu}]", ""))
    out = fold(title_case(name), (r"(?U)'S\b", "'s"), (r"(?U)'T\b", "'t"), (r"(?U)'D\b", "'d"))
    out = fold(lower_connectors(out), (r"(?U)\bW/", "w/"), *((rf"(?U)\b{r}\b", r.upper()) for r in ROMAN), (r"(?U)\b(35|65|70)Mm\b", "$1mm"))
    out = lower_ordinals(out)
    pair = r"(?U)\b[BCDFGHJKLMNPQRSTVWXYZ][bcdfghjklmnpqrstvwxyz]\b"
    words = F.regexp_extract_all(out, F.lit(rf"({pair}|(?s:.))"), F.lit(1))
    out = F.when(out.rlike(pair), F.array_join(F.transform(words, lambda w: F.when(F.length(w) == 2, F.upper(w)).otherwise(w)), "")).otherwise(out)
    return F.when((F.length(name) > 5) & (letters > 0) & (capitals / F.when(letters > 0, letters) > 0.5), out).otherwise(name)


def is_cancelled(name: Column) -> Column:
    return F.upper(name).rlike("^(" + "|".join(CANCELLED) + ")")


def normal_name(name: Column) -> Column:
    """The form in which names are compared: no underscores or punctuation, lower case, single blanks; null as empty."""
    out = F.lower(squeeze_ends(F.replace(F.coalesce(name, F.lit("")), F.lit("_"), F.lit(""))))
    return squeeze(F.regexp_replace(out, r"(?U)[^\w\s]", ""))


def similar_names(a: Column, b: Column) -> Column:
    """Equal normal names, or one in the other from five characters on."""
    a, b = normal_name(a), normal_name(b)
    return (a == b) | ((F.length(a) >= 5) & (F.length(b) >= 5) & (F.contains(a, b) | F.contains(b, a)))


def normal_place(name: Column) -> Column:
    """The form in which places are matched: no punctuation, no leading article of long names, no trailing part of town."""
    low = F.lower(F.coalesce(name, F.lit("")))
    named = low.rlike("(?:- |_)(?:" + "|".join(BOROUGHS) + ")")
    bare = F.regexp_replace(low, r"(?U)[^\w\s]", "")
    virtual = bare.isin("virtual", "online", "livestream")
    bare = F.regexp_replace(bare, r"(?s)^the (?=.{12})", "")  # of names over 15 characters
    # one suffix at most, behind two characters at least
    cut = F.regexp_replace(bare, r"(?s)^(.{2,}) (?:" + "|".join(PLACE_SUFFIXES) + ")$", "$1")
    return F.when(virtual | bare.isin(PLACE_SUFFIXES), "").otherwise(squeeze(F.when(named, bare).otherwise(cut)))


def safe_file_name(name: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(name, r"(?U)[^\p{L}\p{N} _]", ""), F.lit(" "), F.lit("_")))


def display_name(short: Column, name: Column) -> Column:
    """The short name or the name, cut to 35 characters and an ellipsis from 41 on."""
    full = F.coalesce(F.nullif(short, F.lit("")), name, F.lit(""))
    return F.when(F.length(full) > 40, F.concat(F.substring(full, 1, 35), F.lit("…"))).otherwise(full)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def emphasise(text: Column) -> Column:
    """**x** and __x__ as strong, *x* and _x_ (at word edges) as em."""
    return fold(text, (r"\*\*(.*?)\*\*", "<strong>$1</strong>"), (r"(?U)\b__(.*?)__\b", "<strong>$1</strong>"), (r"\*(.*?)\*", "<em>$1</em>"), (r"(?U)\b_(.*?)_\b", "<em>$1</em>"))


def result_name(short: Column, name: Column) -> Column:
    """The display name as a result shows it: strong words marked, emphasis dropped."""
    return F.regexp_replace(emphasise(display_name(short, name)), "</?em>", "")


def blank_if_missing(text: Column) -> Column:
    """Texts that begin like a missing value are empty."""
    return F.when(text.isNull() | text.startswith("None") | text.startswith("N/A"), "").otherwise(text)


def part_sizes(texts: pa.Array) -> list[int]:
    """Numbers of rows whose texts have some PART_BYTES together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.unique(ends // PART_BYTES, return_counts=True)[1].tolist()


def each_text(change: Callable[[str], str | None]):
    """A column function that changes every text but nulls in Python. An Arrow batch may hold 64 MB; its texts are made into strings, changed and sent back in parts."""

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at = 0
            for n in part_sizes(batch):
                yield pa.array([None if t is None else change(t) for t in batch.slice(at, n).to_pylist()], pa.string())
                at += n

    return run


def _search_form(text: str) -> str:
    return text.lower() if text.isascii() else MARKS.sub("", unicodedata.normalize("NFD", text)).lower()


#: Lower case without combining marks (U+0300 to U+036F). Spark has no Unicode decomposition of its own.
search_form = each_text(_search_form)


#: All HTML entities decoded.
decode_html = each_text(html.unescape)


def _first_emoji(text: str) -> str | None:
    return m[0] if (m := one_emoji().search(text)) else None


@functools.cache
def one_emoji():
    """The pattern of an emoji sequence; ``regex`` is needed only where it is used."""
    import regex

    return regex.compile(r"[\U0001F1E6-\U0001F1FF]{2}|\p{Emoji}(?:️⃣?|⃣)?[\U0001F3FB-\U0001F3FF]?(?:‍\p{Emoji}️?[\U0001F3FB-\U0001F3FF]?)*")


#: The first emoji sequence, digits, # and * included, or null.
first_emoji = each_text(_first_emoji)


def is_country_flag(emoji: Column) -> Column:
    return emoji.rlike(r"^[\x{1F1E6}-\x{1F1FF}]+$")


def is_web_url(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
