"""Tags: from hashtags to ordered, rewritten, distinct tags; rules are a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, let, lower_connectors, lower_ordinals, squeeze_ends, where_found


@dataclass(frozen=True)
class TagRules:
    """rewrite: key to tag; exclude: keys never shown; remove: keys whose events go. A key is a tag in lower case without blanks."""

    rewrite: dict[str, str] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def tag_key(tag: Column) -> Column:
    return F.replace(F.lower(tag), F.lit(" "), F.lit(""))


def split_camel(tag: Column) -> Column:
    """Blanks before capitals that begin a word and before numbers; Mc, O' and St. put right (fixed values)."""
    return fold(
        squeeze_ends(F.regexp_replace(tag, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")),
        (r"([a-zA-Z])(\d+)", "$1 $2"),
        (r"\bMc\s+([A-Z])", "Mc$1"),
        (r"\bO\s+([A-Z])", "O'$1"),
        (r"\bSt\s+([A-Z])", "St. $1"),
    )


#: Fixed value: a letter joined to a capital by an ampersand, as in Q&a.
PAIR = r"(?U)\b[A-Z]&[a-z]\b"


def finish(tag: Column) -> Column:
    """Connectors and ordinals in lower case, 4K and 3D joined, Q&A in capitals."""
    out = fold(lower_connectors(tag), (r"(?U)\b(\d+)\s+K\b", "$1K"), (r"(?U)\b(\d+)\s+D\b", "$1D"))
    pieces = lambda t: F.regexp_extract_all(t, F.lit(rf"({PAIR}|(?s:.))"), F.lit(1))
    raised = lambda t: F.array_join(F.transform(pieces(t), lambda x: F.when(F.length(x) == 3, F.upper(x)).otherwise(x)), "")
    return where_found(lower_ordinals(out), PAIR, raised)


def rewrite(tag: Column, rules: TagRules) -> Column:
    if not rules.rewrite:
        return tag
    table = F.create_map(*(F.lit(x) for pair in rules.rewrite.items() for x in pair))
    return let(tag, lambda t: F.coalesce(F.try_element_at(table, tag_key(t)), t))


def distinct_by_key(tags: Column) -> Column:
    """The first tag of each key, in order."""
    # named once: an expression inside a lambda is worked out anew for each element
    pairs = F.transform(tags, lambda t: F.struct(tag_key(t).alias("key"), t.alias("tag")))
    first = lambda ps: let(F.transform(ps, lambda p: p["key"]), lambda keys: F.filter(ps, lambda p, i: F.array_position(keys, p["key"]) == i + 1))
    return F.transform(let(pairs, first), lambda p: p["tag"])


def raw_tags(hashtags: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(hashtags, F.lit("")), "#"), squeeze_ends), lambda t: t != "")
    return F.transform(parts, lambda t: F.regexp_replace(t, ",+$", ""))


def process(hashtags: Column, rules: TagRules, extra: Column | None = None) -> Column:
    """The tags of a hashtag string; extra tags come first and are not rewritten."""
    own = F.transform(raw_tags(hashtags), lambda t: finish(rewrite(split_camel(t), rules)))
    every = own if extra is None else F.concat(F.coalesce(extra, strings([])), own)
    return distinct_by_key(F.filter(every, lambda t: ~F.array_contains(strings(rules.exclude), tag_key(t))))


def with_virtual(tags: Column, location: Column) -> Column:
    """The tag Virtual besides, for places that are none."""
    place = F.lower(F.coalesce(location, F.lit("")))
    return let(tags, lambda ts: F.when(place.rlike("virtual|online|livestream") & ~F.array_contains(ts, "Virtual"), F.array_append(ts, F.lit("Virtual"))).otherwise(ts))


def keeps(tags: Column, rules: TagRules) -> Column:
    """Whether no tag is to be removed."""
    return ~F.arrays_overlap(F.transform(tags, tag_key), strings(rules.remove))
