"""Personal data replaced by surrogates, in DataFrame functions only.

Detection is one regular expression over the text; a match's type follows from its form. Names are found after titles (up to three words),
and every other mention of such a word in the same document is the same name. Each distinct entity of the corpus (type and
canonical form) gets one surrogate, drawn from a keyed SHA-256 stream: digits for digits, letters for letters of the same
script, octets for octets, hex for hex; card numbers and IBANs keep their check sums, telephone numbers their country code, e-mail
addresses their top-level domain. Names are put together from syllables of given names of the same script, with an ending of the grammatical
gender taken from the titles before them. A draw is refused if it is a real entity of the corpus or another entity's surrogate; the loser
draws again, and after GROW_AFTER rounds from a space that grows with each round, for every type: names by a syllable, e-mail addresses and secrets by a
letter in front, numbers and keys by a digit behind, octets to all of 0 to 255 (and, when none of these is free, to a fifth), hex groups to four digits and then by groups. So the
draws end however many entities there are of one form, distinct entities stay distinct, one entity has one surrogate in all documents and
spellings (case, punctuation), and the spelling of each place is kept. Drawing and spelling take time in proportion to an entity's length.

Only documents with a match are shuffled, and a match is joined by its entity; entities are summed up before the shuffle, so one address in
a third of all rows is one row there.

Defined results: a null text stays null with no entities; an empty text stays empty. Rows with a null or repeated doc_id are replaced
like any other. An empty table gives no rows. Columns that clash with a result's name are replaced by the result. Without the key a
surrogate cannot be told from the entity; the key is the caller's (``corpus_key`` reads it from the session).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

#: Draws of an entity's own form before its space grows; growths before an address has a fifth octet.
GROW_AFTER, WIDEST = 2, 40
TITLES_M = r"Mr\.|Herr|Monsieur|Señor|Sr\.|господин|κύριος"
TITLES_F = r"Mrs\.|Ms\.|Miss|Frau|Madame|Mme|Señora|Sra\.|госпожа|κυρία"
TITLES_N = r"Dr\.|Prof\."
TITLE = f"(?:{TITLES_M}|{TITLES_F}|{TITLES_N})"
#: (type, form of a whole match)
FORMS = {
    "EMAIL": r"(?<![\p{L}0-9._%+-])[\p{L}0-9][\p{L}0-9._%+-]*+@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++){0,126}\.\p{L}{2,24}(?![\p{L}0-9])",
    "IP": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "SSN": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "CARD": r"(?<![0-9-])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9-])",
    "IBAN": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3}|[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "IP6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "PHONE": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+(?=(?:[ .()-]{0,2}[0-9]){8,15}(?![0-9]))[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,13}\)?){1,6}(?![0-9])|(?<![0-9+.-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])",
    "KEY": r"(?<![A-Z0-9a-z])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9a-z])",
    "HEX": r"(?<![A-Za-z0-9])(?=[a-fA-F]{0,40}[0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])",
    "SECRET": r"(?<![\p{L}0-9_-])(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9][A-Za-z0-9_+/-]{7,}+",
    "NAME": "|".join(rf"(?<!\p{{L}})\p{{Lu}}\p{{L}}++(?<=(?<!\p{{L}}){TITLE} {before}\p{{L}}{{2,30}})" for before in ("", r"\p{Lu}\p{L}{1,30} ", r"\p{Lu}\p{L}{1,30} \p{Lu}\p{L}{1,30} ")),
}
#: The shorter alternatives come after the longer ones that may begin at the same place.
ORDER = ("EMAIL", "KEY", "HEX", "SECRET", "IBAN", "CARD", "PHONE", "SSN", "IP", "IP6", "NAME")
_groups = {"CARD": FORMS["CARD"].replace(r"([ -]?)", r"(?<sep>[ -]?)", 1).replace(r"\1", r"\k<sep>").replace(r"([ -]?)", r"(?<gap>[ -]?)").replace(r"\2", r"\k<gap>")}
PATTERN = "|".join(f"(?:{_groups.get(t, FORMS[t])})" for t in ORDER)
#: A text without any of these holds no entity; the test is cheap.
HINT = r"[0-9@]|" + TITLE + r" \p{Lu}"
SECRET_HINT = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key) {0,2}[=:]"

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Letters by script.
SCRIPTS = {"Latin": LATIN, "Cyrillic": "бвгджзклмнпрстфаеиоу", "Greek": "βγδζθκλμνπρστφχαειου"}
HAN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华建文辉玲志林"
#: Beginnings of given names by script, and their endings by gender (feminine, masculine, unknown).
NAMES = {
    "Latin": ("al an ar bel ben bri cal cor dan dor el em fen gab hal ing jon jul kar len lor mar mel nor ol per ros sam tam ul vik wil".split(), {"F": "a ia ina ella etta anna isa ora".split(), "M": "o us an in son er ard ert".split(), "": "el en is ley ton am ris ey".split()}),
    "Cyrillic": ("ал бор вик гал дан ел жан иг кир лар мар ник ол пав сер там".split(), {"F": "а ина ова ева".split(), "M": "ий ан ей ов".split(), "": "ен ко ич ук".split()}),
    "Greek": ("αλ βασ γερ δημ ελ ζην θεο κων λεω μαρ νικ παν σοφ στελ τασ φιλ".split(), {"F": "α ια ινη ου".split(), "M": "ος ης ας ων".split(), "": "ιδη ακη εα οπη".split()}),
}


def kind_of(hit: Column) -> Column:
    """The type of a whole match, by its form alone."""
    digits = F.regexp_replace(hit, r"[^0-9]", "")
    return (
        F.when(F.contains(hit, F.lit("@")), "EMAIL")
        .when(hit.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$"), "KEY")
        .when(hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "SSN")
        .when(hit.rlike(r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})$"), "CARD")
        .when(hit.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "IP")
        .when(hit.rlike("^[0-9A-Fa-f:]+$") & F.contains(hit, F.lit(":")), "IP6")
        .when(hit.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{12,}$") & hit.rlike(FORMS["IBAN"]), "IBAN")
        .when(hit.rlike(r"^[0-9+() .-]+$") & (F.length(digits) >= 8) & hit.rlike(r"[+( .-]"), "PHONE")
        .when(hit.rlike(r"^[0-9a-fA-F]{32,64}$"), "HEX")
        .when(hit.rlike(r"^\p{Lu}\p{L}+$"), "NAME")
        .otherwise("SECRET")
    )


def canonical(kind: Column, hit: Column) -> Column:
    """The spelling by which two matches are one entity; of telephone numbers the digits, without the 1 of North America."""
    digits = F.regexp_replace(hit, r"[^0-9]", "")
    return F.when(kind == "PHONE", F.regexp_replace(digits, "^1(?=[0-9]{10}$)", "")).when(kind.isin("CARD", "SSN"), digits).when(kind == "SECRET", hit).when(kind == "IBAN", F.replace(hit, F.lit(" "))).otherwise(F.lower(hit))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""
    n = F.length(digits)

    def part(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10


def iban_check(iban: Column) -> Column:
    """An IBAN with the two check digits that its other characters call for."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00"))

    def add(s, c):
        letter = c.rlike("[A-Z]")
        return F.when(letter, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97)

    rest = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1))), F.lit(0), add)
    return F.concat(F.substring(iban, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(iban, F.lit(5), F.length(iban)))


def _pick(letters: str, v: Column) -> Column:
    return F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1))


def _one(words: list[str], v: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), v % len(words))


#: Kinds that grow at their front, by letters, and at their end, by what their form has there.
FRONT, BACK = ("EMAIL", "SECRET"), ("PHONE", "SSN", "CARD", "KEY", "HEX", "IBAN")
#: One letter for each class of characters, in the order in which they are told; entities hold no control characters.
CLASSES = {"[0-9]": "\x01", **{rf"[\p{{Is{s}}}&&\p{{Lu}}]": c for s, c in zip(SCRIPTS, "\x02\x04\x06", strict=True)}, **{rf"\p{{Is{s}}}": c for s, c in zip(SCRIPTS, "\x03\x05\x07", strict=True)}, r"\p{IsHan}": "\x08", r"\p{L}": "\x0e"}
HEX_CLASS = "\x0f"


def grown_form(kind: Column, canon: Column, more: int) -> Column:
    """The form that the n-th wider space has: octets and names are widened where they are drawn."""
    if not more:
        return canon
    # hex groups in full; where groups are left out, more and more of them are written
    full = F.regexp_replace(canon, r"[0-9a-f]+", "0000")
    left = F.greatest(F.lit(0), F.least(F.lit(more - 1), 6 - (F.length(full) - F.length(F.replace(full, F.lit(":"))) - 1)))
    full = F.when(F.contains(full, F.lit("::")), F.replace(full, F.lit("::"), F.concat(F.repeat(F.lit(":0000"), left), F.lit("::")))).otherwise(full)
    front, back = F.concat(F.lit("a" * more), canon), F.concat(canon, F.lit("0" * more))
    return F.when(kind.isin(*FRONT), front).when(kind.isin(*BACK), back).when(kind == "IP6", full).when((kind == "NAME") & canon.rlike(r"^\p{IsHan}"), F.concat(F.lit(HAN[0] * more), canon)).otherwise(canon)


def draw(key: str, kind: Column, canon: Column, gender: Column, attempt: int) -> Column:
    """The surrogate of an entity at its n-th draw, in canonical spelling."""
    more = max(0, attempt - GROW_AFTER)
    form = grown_form(kind, canon, more)
    classes = form
    for pattern, letter in CLASSES.items():
        classes = F.regexp_replace(classes, pattern, letter)
    classes = F.when(kind.isin("HEX", "IP6"), F.regexp_replace(form, "[0-9a-f]", HEX_CLASS)).otherwise(classes)
    # the entity is hashed once: what stands in a lambda is worked out again for each block
    seed = F.concat_ws("\x1f", F.lit(key), F.xxhash64(canon).cast("string"), F.sha2(canon, 256), kind, F.lit(str(attempt)))
    numbers = F.sequence(F.lit(0), F.ceil(F.length(form) / 32).cast("int"))
    blocks = F.get(F.transform(F.array(seed), lambda s: F.transform(numbers, lambda b: F.sha2(F.concat_ws("\x1f", s, b.cast("string")), 256))), F.lit(0))
    n = F.length(form)
    top = F.when(kind == "EMAIL", F.length(F.substring_index(form, ".", -1))).otherwise(0)
    held = F.when(kind == "KEY", 4).when(kind == "IBAN", 2).when((kind == "PHONE") & (n > 10), 2).otherwise(0)
    # all that a character needs is computed once for each entity
    once = F.struct(form.alias("form"), F.split(form, "").alias("chars"), F.split(classes, "").alias("classes"), blocks.alias("blocks"), (n - top).alias("stop"), held.alias("held"))
    return F.get(F.transform(F.array(once), lambda x: _draw(kind, x, gender, more)), F.lit(0))


def _number(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("int")


def _draw(kind: Column, x: Column, gender: Column, more: int) -> Column:
    canon, first = x["form"], F.get(x["blocks"], F.lit(0))
    value = lambda i: _number(F.substring(F.get(x["blocks"], F.floor((i - 1) / 32).cast("int")), 2 * ((i - 1) % 32) + 1, F.lit(2)))

    def plain(c, at):
        i, k = at + 1, F.get(x["classes"], at)
        v = value(i)
        out = F.when((i > x["stop"]) | (i <= x["held"]), c).when(k == HEX_CLASS, _pick("0123456789abcdef", v)).when(k == "\x01", _pick("0123456789", v))
        for letters, upper, lower in zip(SCRIPTS.values(), "\x02\x04\x06", "\x03\x05\x07", strict=True):
            out = out.when(k == lower, _pick(letters, v)).when(k == upper, F.upper(_pick(letters, v)))
        return out.when(k == "\x08", _pick(HAN, v)).when(k == "\x0e", _pick(LATIN, v)).otherwise(c)

    general = F.array_join(F.transform(x["chars"], plain), "")
    name = None
    for script, (starts, ends) in reversed(NAMES.items()):
        word = F.concat(*(_one(starts, _number(F.substring(first, F.lit(4 * i + 1), F.lit(4)))) for i in range(min(2 + more, 15))))
        last = _number(F.substring(first, F.lit(61), F.lit(4)))
        made = F.concat(word, F.when(gender == "F", _one(ends["F"], last)).when(gender == "M", _one(ends["M"], last)).otherwise(_one(ends[""], last)))
        name = made if name is None else F.when(canon.rlike(rf"^\p{{Is{script}}}"), made).otherwise(name)
        if script == "Latin":
            name = F.when(canon.rlike(r"^\p{IsHan}"), general).when(canon.rlike(r"^\p{IsCyrillic}|^\p{IsGreek}"), name).otherwise(name)
    # the last digit restores the Luhn remainder; it counts once
    head = F.substring(general, F.lit(1), F.length(canon) - 1)
    card = F.concat(head, F.pmod(luhn(canon) - luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
    octet = lambda p, i: value(i + 1).cast("string") if more else F.when(F.length(p) == 1, value(i + 1) % 10).when(F.length(p) == 2, 10 + value(i + 1) % 90).otherwise(100 + value(i + 1) % 156).cast("string")
    parts = F.split(canon, r"\.")
    # after all addresses of four octets a fifth, which none has
    ip = F.array_join(F.transform(F.concat(parts, F.array(F.lit("0"))) if more > WIDEST else parts, octet), ".")
    return F.when(kind == "CARD", card).when(kind == "IP", ip).when(kind == "IBAN", iban_check(general)).when(kind == "NAME", name).otherwise(general)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, fake, more) for distinct entities (kind, canon, gender): draws until all are apart from each other and from all entities.

    ``more`` says by how much the form has grown. Every kind's space grows without end, so the draws do.
    """
    real = entities.select("kind", F.col("canon").alias("fake"))
    todo, settled, n = entities, None, 0
    while True:
        drawn = todo.withColumn("fake", draw(key, F.col("kind"), F.col("canon"), F.col("gender"), n))
        free = drawn.join(real, ["kind", "fake"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "fake"), ["kind", "fake"], "left_anti")
        won = materialise(free.groupBy("kind", "fake").agg(F.min("canon").alias("canon")).withColumn("more", F.lit(max(0, n - GROW_AFTER))), "surrogates")
        settled = won if settled is None else settled.unionByName(won)
        todo = todo.join(won, ["kind", "canon"], "left_anti")
        if todo.isEmpty():
            return settled
        n += 1


def named_like(fake: Column, hit: Column) -> Column:
    """A name in the case of a place."""
    return F.when((hit == F.upper(hit)) & (F.length(hit) > 1), F.upper(fake)).otherwise(F.concat(F.upper(F.substring(fake, 1, 1)), F.substring(fake, F.lit(2), F.length(fake))))


def written_like(fake: Column, hit: Column, kind: Column, more: Column) -> Column:
    """A canonical surrogate in the spelling of a place: its punctuation, country code and case; what has grown stands before or behind."""
    letter = r"[\p{L}0-9]"
    old, plain = F.regexp_extract_all(hit, F.lit(letter), F.lit(0)), F.regexp_extract_all(fake, F.lit(letter), F.lit(0))
    front, back = F.when(kind.isin(*FRONT), more).otherwise(0), F.when(kind.isin(*BACK), more).otherwise(0)
    shout = (hit == F.upper(hit)) & hit.rlike(r"\p{L}")
    once = F.struct(old.alias("old"), plain.alias("plain"), F.split(hit, letter, -1).alias("gaps"), shout.alias("shout"), front.alias("front"), back.alias("back"), (F.size(old) - F.size(plain) + front + back).alias("ahead"))

    def write(x):
        def put(c, i):  # ahead: of a telephone number, the country code
            f = F.get(x["plain"], i - x["ahead"] + x["front"])
            return F.when(i < x["ahead"], c).when(x["shout"] | ((c == F.upper(c)) & (c != F.lower(c))), F.upper(f)).otherwise(f)

        body = F.zip_with(x["gaps"], F.transform(x["old"], put), lambda g, f: F.concat(g, F.coalesce(f, F.lit(""))))
        case = lambda part: F.when(x["shout"], F.upper(part)).otherwise(part)
        before = case(F.array_join(F.slice(x["plain"], F.lit(1), x["front"]), ""))
        behind = case(F.array_join(F.slice(x["plain"], F.size(x["plain"]) - x["back"] + 1, x["back"]), ""))
        return F.concat(before, F.array_join(body, ""), behind)

    kept = F.get(F.transform(F.array(once), write), F.lit(0))
    groups = F.when(shout, F.upper(fake)).otherwise(fake)
    return F.when(kind == "KEY", F.upper(fake)).when(kind.isin("IP", "SECRET"), fake).when(kind == "NAME", named_like(fake, hit)).when((kind == "IP6") & (more > 0), groups).otherwise(kept)


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (with surrogates), n_entities and the columns ``keep``."""
    keep = tuple(c for c in keep if c not in ("doc_id", "text", "n_entities", text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    hinted = F.coalesce(F.col("text").rlike(HINT) | F.col("text").rlike(SECRET_HINT), F.lit(False))
    found = F.when(hinted, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("hits", found)
    clean = rows.where(F.size("hits") == 0).select("doc_id", "text", F.lit(0).alias("n_entities"), *keep)
    held = rows.where(F.size("hits") > 0).withColumn("gaps", F.split("text", PATTERN, -1)).withColumn("ver", F.xxhash64("text"))
    dirty = materialise(held.select("doc_id", "ver", "text", "hits", "gaps", *keep), "entities")

    spots = dirty.select("doc_id", "ver", "gaps", F.posexplode("hits").alias("i", "hit")).withColumn("kind", kind_of(F.col("hit")))
    before = F.get("gaps", F.col("i"))
    gender = F.when(F.col("kind") == "NAME", F.when(before.rlike(rf"(?:{TITLES_F}) $"), "F").when(before.rlike(rf"(?:{TITLES_M}) $"), "M"))
    spots = spots.select("doc_id", "ver", "i", "hit", "kind", canonical(F.col("kind"), F.col("hit")).alias("canon"), gender.alias("gender"))
    entities = spots.groupBy("kind", "canon").agg(F.min("gender").alias("g0"), F.max("gender").alias("g1"))
    entities = entities.select("kind", "canon", F.when(F.col("g0") == F.col("g1"), F.col("g0")).otherwise(F.lit("")).alias("gender"))
    entities = materialise(entities.repartition("canon"), "entities")
    fakes = surrogates(entities, key)

    # rows that share id and text are one document here; each gets its list back
    pairs = spots.dropDuplicates(["doc_id", "ver", "i"]).join(fakes, ["kind", "canon"]).select("doc_id", "ver", "i", "hit", "kind", F.when(F.col("kind") == "NAME", F.struct("canon", F.col("fake").alias("own"))).alias("name"), written_like(F.col("fake"), F.col("hit"), F.col("kind"), F.col("more")).alias("fake"))
    by_doc = pairs.groupBy("doc_id", "ver").agg(F.array_sort(F.collect_list(F.struct("i", "fake"))).alias("put"), F.map_from_entries(F.collect_set("name")).alias("names"))
    met = dirty.alias("d").join(by_doc.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.ver") == F.col("p.ver"))).select("d.*", "p.put", "p.names")
    # the names of a document wherever else they stand in it, in any case but small letters
    words = lambda g: F.split(g, r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})", -1)
    again = lambda g: F.array_join(F.transform(words(g), lambda w: F.when(w.rlike(r"^\p{Lu}\p{L}"), F.coalesce(named_like(F.try_element_at("names", F.lower(w)), w), w)).otherwise(w)), "")
    gaps = F.when(F.size("names") > 0, F.transform("gaps", again)).otherwise(F.col("gaps"))
    out = F.array_join(F.flatten(F.zip_with(gaps, "put", lambda g, f: F.array(g, F.coalesce(f["fake"], F.lit(""))))), "")
    done = met.select("doc_id", out.alias("text"), F.size("hits").alias("n_entities"), *keep)
    return clean.unionByName(done)


def corpus_key(spark: SparkSession) -> str:
    """The key that the session names. Where it names none it gets one of its own, which no one can read out of the code."""
    name = "spark.whenwhere.pii.key"
    if not (spark.conf.get(name, None) or spark.sparkContext.getConf().get(name, None)):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"), corpus_key(spark))
