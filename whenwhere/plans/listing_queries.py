"""Registered queries of the batch side, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo, tags, text, url, when
from ..operators import listing as L
from ..operators import view as V
from ..sources import files
from ..sources.stages import shared_root, staged
from ..streaming import incremental
from . import batch
from . import model as M

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


SPACE = r"[\x09-\x0D \x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sanitize_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for a, b in text.ENTITIES:
        out = f"replace({out}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace(regexp_replace({out}, '[\\x{{200B}}\\x{{200C}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g'), '{SPACE}+', ' ', 'g'))"


@query(f"select page_id, md5({_sanitize_sql('html')}) as text_md5, length({_sanitize_sql('html')}) as n from pages")
def q_sanitize_html(spark, d):
    out = M.table(spark, d, "pages").select("page_id", text.sanitize(F.col("html")).alias("t"))
    return out.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n"))


@query("select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) as text_md5 from pages")
def q_escape_html(spark, d):
    return M.table(spark, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("text_md5"))


NAMES = "(case p_partkey % 6 when 0 then 'Concert: ' || p_name || ' w/ ' || p_brand when 1 then p_name || ' of ' || p_type || ' and everything beyond: ' || p_name || ' night' when 2 then p_name || ' (' || p_brand || ') with ' || p_type when 3 then p_name || ' at ' || p_type when 4 then p_name || ' - Q&A with ' || p_brand else 'Talks - ' || p_name || ' @ ' || p_brand end)"


@query(
    "select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\s*\\([^)]*\\)', '', 'g'), '\\s*[-–]\\s*Q&A\\s+with\\s+.*$', ''), '\\s*\\\\?\\s*\\|\\s*with\\s+.*$', ''), '\\s+w/\\s+.*$', ''), '\\s+with\\s+.*$', '', 'i'), '\\s+at\\s+.*$', '', 'i'), '\\s*@.*$', ''), '\\s+', ' ', 'g')) as short_name"
    f" from (select p_partkey, case when length(p) > 40 and contains(p, ':') and length(trim(regexp_replace(p, '^[^:]*:', ''))) > 3 then trim(regexp_replace(p, '^[^:]*:', '')) else p end as s from (select p_partkey, regexp_replace(regexp_replace({NAMES}, '^Talks?\\s*[:\\-]\\s*', '', 'i'), '^Concert\\s*[:\\-]\\s*', '', 'i') as p from part))"
)
def q_short_name(spark, d):
    return M.table(spark, d, "part").select("p_partkey", text.short_name(F.expr(NAMES)).alias("short_name"))


CAPS = "upper(p_name || ' and the ' || p_brand || ' dj 2nd tv ii w/ 35mm baker''s')"
_title = "array_to_string(list_transform(regexp_extract_all(n, '([A-Za-z]+|[^A-Za-z]+)'), lambda r: upper(r[1]) || lower(r[2:])), '')"
_steps = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_title}, '''S\\b', '''s', 'g'), ' And\\b', ' and', 'g'), ' The\\b', ' the', 'g'), '\\bW/', 'w/', 'g'), '\\bIi\\b', 'II', 'g'), '\\b(35|65|70)Mm\\b', '\\1mm', 'g')"
_ord = f"regexp_replace({_steps}, '(\\d+)Nd\\b', '\\1nd', 'g')"


@query(f"select p_partkey, array_to_string(list_transform(regexp_extract_all(x, '(\\b[BCDFGHJKLMNPQRSTVWXYZ][bcdfghjklmnpqrstvwxyz]\\b|.)'), lambda w: case when length(w) = 2 then upper(w) else w end), '') as name from (select p_partkey, {_ord} as x from (select p_partkey, {CAPS} as n from part))")
def q_recapitalise(spark, d):
    return M.table(spark, d, "part").select("p_partkey", text.recapitalise(F.expr(CAPS)).alias("name"))


RULES = tags.TagRules({"redwidget": "Widgets", "livemusic": "Music"}, ("small",), ("economy",))
_cap = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')"
_camel = "regexp_replace(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-zA-Z])(\\d+)', '\\1 \\2', 'g')"


def _hashtags():
    return F.concat(F.lit("#"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit(" #LiveMusic, #Music #Catch22 #"), F.initcap("p_type"))


@query(f"select p_partkey, {_camel} as tag from (select p_partkey, unnest([{_cap}, 'NYCArt' || p_size]) as t from part)")
def q_tag_split(spark, d):
    both = F.explode(F.array(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.concat(F.lit("NYCArt"), F.col("p_size"))))
    return M.table(spark, d, "part").select("p_partkey", both.alias("t")).select("p_partkey", tags.split_camel(F.col("t")).alias("tag"))


@query(
    f"""with t as (select p_partkey, case when {_cap} = 'RedWidget' then 'Widgets' else regexp_replace({_cap}, '([a-z])([A-Z])', '\\1 \\2', 'g') end as a, upper(p_type[1]) || lower(p_type[2:]) as b, p_type from part)
select p_partkey, array_to_string(list_filter([a, 'Music', 'Catch 22', b], lambda x: x <> 'Small'), '|') as tags, lower(p_type) <> 'economy' as kept from t"""
)
def q_tag_rules(spark, d):
    rows = text.spread(M.table(spark, d, "part")).select("p_partkey", tags.process(_hashtags(), RULES).alias("t"))
    return rows.select("p_partkey", F.array_join("t", "|").alias("tags"), tags.keeps(F.col("t"), RULES).alias("kept"))


@query("select event_id, replace(replace(replace(lower(strftime(ts, '%-I:%M %p')), ' ', ''), '.', ''), ':00', '') as time, (hour(ts) * 60 + minute(ts))::int as minutes from events")
def q_time_standardise(spark, d):
    rows = M.table(spark, d, "events").select("event_id", when.standard_time(F.date_format("ts", "h:mm a")).alias("time"))
    return rows.withColumn("minutes", when.minutes_of(F.col("time")).cast("int"))


@query("select event_id, epoch_us(ts::date::timestamp) + (hour(ts) * 60 + minute(ts)) * 60000000 + epoch_us(timezone('America/New_York', ts::date::timestamp + interval 12 hour)) - epoch_us(ts::date::timestamp + interval 12 hour) as instant_us from events")
def q_ny_instant(spark, d):
    rows = M.table(spark, d, "events")
    return rows.select("event_id", F.unix_micros(when.local_instant(F.to_date("ts"), F.hour("ts") * 60 + F.minute("ts"))).alias("instant_us"))


@query(f"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(replace(coalesce(text, ''), '_', ''), '^{SPACE}+|{SPACE}+$', '', 'g')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\x09-\\x0D \\x{{85}}\\x{{A0}}]', '', 'g'), '{SPACE}+', ' ', 'g'))) as name_md5 from documents")
def q_name_normalise(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.md5(text.normal_name(F.col("text"))).alias("name_md5"))


PLACES = "(case s_suppkey % 5 when 0 then 'The Grand ' || s_name || ', New York' when 1 then s_name || ' - Brooklyn' when 2 then s_name || ' Queens' when 3 then 'Brooklyn' else 'the ' || s_name end)"


@query(
    f"""with p as (select s_suppkey, s_suppkey % 5 = 1 as named, regexp_replace(lower({PLACES}), '[^a-z0-9_\\s]', '', 'g') as b from supplier),
q as (select s_suppkey, named, case when length(b) > 15 and starts_with(b, 'the ') then b[5:] else b end as b from p)
select s_suppkey, case when b in ('brooklyn', 'queens') then '' when named then trim(regexp_replace(b, '\\s+', ' ', 'g')) else trim(regexp_replace(b, ' (new york|brooklyn|queens)$', '')) end as place from q"""
)
def q_place_normalise(spark, d):
    return M.table(spark, d, "supplier").select("s_suppkey", text.normal_place(F.expr(PLACES)).alias("place"))


@query(f"""select l_orderkey, l_linenumber from (select *, l_shipdate::date as s, case when l_linenumber % 3 = 0 then null else l_shipdate::date + (l_quantity::int * 10) end as e from lineitem)
where s <= date '{M.AS_OF}' + 90 and coalesce(e, s) >= date '{M.AS_OF}' and coalesce(e, s) - s <= 400""")
def q_date_window_raw(spark, d):
    li = M.table(spark, d, "lineitem").withColumn("s", F.to_date("l_shipdate").cast("string"))
    li = li.withColumn("e", F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).otherwise(F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") * 10).cast("string")))
    return li.where(when.within_reach(F.col("s"), F.col("e"), F.lit(M.AS_OF).cast("date"))).select("l_orderkey", "l_linenumber")


@query("select doc_id from documents where contains(lower(strip_accents(text)), 'eaue')")
def q_search_text(spark, d):
    return M.table(spark, d, "documents").where(F.contains(text.search_form(F.col("text")), F.lit("eaue"))).select("doc_id")


def _gazetteer(spark, d):
    c, n = M.table(spark, d, "customer"), M.table(spark, d, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    return rows.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.array(F.concat("c_name", F.lit(" Hall"))).alias("alternate_names"), F.concat("n_name", F.lit(" Room "), F.col("c_custkey") % 7).alias("short_name"), F.col("c_custkey").cast("double").alias("lat"), F.lit(0.0).alias("lng"), F.lit("x").alias("emoji"))


def _placed(spark, d):
    s = M.table(spark, d, "supplier")
    name = F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))
    place = F.when(F.col("s_suppkey") % 4 == 0, name).when(F.col("s_suppkey") % 4 == 1, F.concat(name, F.lit(" hall"))).when(F.col("s_suppkey") % 4 == 2, F.concat(name, F.lit(", Floor 2"))).otherwise(F.concat(F.lit("Room "), F.col("s_suppkey") % 7))
    return s.select(F.col("s_suppkey").alias("row_id"), place.alias("location"), F.lit("").alias("sublocation"), F.lit("x").alias("name"))


GAZ = """k as (select c_custkey as pos, unnest([{'tier': 0, 'n': c_name}, {'tier': 1, 'n': c_name || ' Hall'}, {'tier': 2, 'n': n_name || ' Room ' || (c_custkey % 7)}], recursive := true) from customer join nation on c_nationkey = n_nationkey),
k2 as (select distinct pos, tier, unnest([lower(n), regexp_replace(lower(n), '[^a-z0-9_ ]', '', 'g')]) as key from k),
g as (select tier, key, min(pos) as pos, max(pos) as place from k2 where length(key) >= 3 group by 1, 2),
r as (select s_suppkey as row_id, regexp_replace(lower(case s_suppkey % 4 when 0 then replace(s_name, 'Supplier', 'Customer') when 1 then replace(s_name, 'Supplier', 'Customer') || ' hall' when 2 then replace(s_name, 'Supplier', 'Customer') || ', Floor 2' else 'Room ' || (s_suppkey % 7) end), '[^a-z0-9_ ]', '', 'g') as loc from supplier)"""


@query(f"with {GAZ} select row_id, arg_min(tier, tier) as tier, arg_min(place, tier)::double as lat from r join g on g.key = r.loc where length(key) > 3 group by 1")
def q_exact_tier_match(spark, d):
    found = L.match_exact(L.search_keys(_placed(spark, d)), L.gazetteer(_gazetteer(spark, d)), "row_id")
    return found.select("row_id", "tier", F.col("place.lat").alias("lat"))


@query(f"""with {GAZ}, ra as (select loc, key, tier, pos, place, row_id, case when starts_with(loc, key) or ends_with(loc, key) then 0.9 + length(key)::double / length(loc) * 0.09
  else (length(loc) + length(key) - levenshtein(loc, key))::double / (length(loc) + length(key)) end as score from r join g on contains(loc, key) and length(key) > 3 or contains(key, loc) and length(loc) > 3),
b as (select *, row_number() over (partition by row_id order by score desc, tier, pos) as n from ra where score >= 0.85)
select row_id, tier, place::double as lat, round(score, 9) as score from b where n = 1""")
def q_fuzzy_match(spark, d):
    found = L.match_fuzzy(L.search_keys(_placed(spark, d)), L.gazetteer(_gazetteer(spark, d)), "row_id")
    return found.select("row_id", "tier", F.col("place.lat").alias("lat"), F.round("score", 9).alias("score"))


@query("""with k as (select n_nationkey as pos, lower(n_name) as key from nation where length(n_name) >= 3), s as (select s_suppkey as row_id, lower(n_name || 's') as site from supplier join nation on s_nationkey = n_nationkey),
x as (select row_id, pos, (length(site) + length(key) - levenshtein(site, key))::double / (length(site) + length(key)) as score from s join k on true), y as (select *, row_number() over (partition by row_id order by score desc, pos) as n from x where score >= 0.85)
select row_id, pos::double as lat, round(score, 9) as score from y where n = 1""")
def q_site_fallback(spark, d):
    n = M.table(spark, d, "nation")
    places = n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("short_name"), F.lit(None).cast("array<string>").alias("alternate_names"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lng"), F.lit("").alias("emoji"))
    s = M.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("row_id"), F.concat("n_name", F.lit("s")).alias("site"))
    found = L.match_site(s, L.gazetteer(places), "row_id", "site")
    return found.select("row_id", F.col("place.lat").alias("lat"), F.round("score", 9).alias("score"))


_host = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query(f"select page_id, coalesce(t, '') as tags from pages left join (select u, max_by(t, p) as t from (select lower(regexp_replace(url, '/+$', '')) as u, page_id as p, 'host:' || {_host} as t from pages) group by 1) on lower(regexp_replace(url, '/+$', '')) = u")
def q_extra_tags(spark, d):
    pages = M.table(spark, d, "pages")
    sites = pages.select("page_id", F.array("url").alias("urls"), F.array(F.concat(F.lit("host:"), text.host_of(F.col("url")))).alias("extra_tags"))
    met = pages.withColumn("url_key", files.url_key(F.col("url"))).join(files.site_tags(sites, "page_id"), "url_key", "left")
    return met.select("page_id", F.coalesce(F.array_join("extra_tags", ","), F.lit("")).alias("tags"))


_norm = "trim(regexp_replace(regexp_replace(lower(regexp_replace(replace(text, '_', ''), '^\\s+|\\s+$', '', 'g')), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _turns(spark, d):
    c = M.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("name"), F.concat(F.lit("2024-01-0"), F.col("turn") % 3 + 1).alias("start_date"), F.lit("7:00 PM").alias("start_time"), F.lit("").alias("end_date"), F.lit("").alias("end_time"))


@query(f"""select conv_id, min(turn) as first_at, md5(arg_min(text, (length(text), turn))) as name_md5, count(distinct turn % 3) as n_occurrences from conversations where text <> ''
 and not regexp_matches(upper(text), '^(CANCELED:|CANCELLED:|KIM:|KIM -)') group by conv_id, {_norm}""")
def q_group_exact(spark, d):
    rows = L.group_exact(_turns(spark, d), "conv_id", "turn")
    return rows.select("conv_id", "first_at", F.md5("name").alias("name_md5"), F.size("occurrences").cast("long").alias("n_occurrences"))


@query()
def q_group_fuzzy(spark, d):
    return L.group_fuzzy(_turns(spark, d), "conv_id", "turn")


def _doc_events(spark, d):
    t = M.table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("pos"), F.col("text").alias("name"), F.col("lang").alias("description"), F.length("source").cast("double").alias("lat"), F.lit(0.0).alias("lng"), F.array(F.struct(F.col("lang").alias("start_date"))).alias("occurrences"))


_dnorm = f"trim(regexp_replace(regexp_replace(lower(regexp_replace(replace(coalesce(text, ''), '_', ''), '^{SPACE}+|{SPACE}+$', '', 'g')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\x09-\\x0D \\x{{85}}\\x{{A0}}]', '', 'g'), '{SPACE}+', ' ', 'g'))"


@query(f"select length(source)::double as lat, lang as first_start, arg_min(doc_id, (length(text), doc_id)) as pos, count(*) as n_merged from documents group by 1, 2, {_dnorm}")
def q_dedup_exact(spark, d):
    return L.dedup_exact(_doc_events(spark, d)).select("lat", "first_start", "pos", "n_merged")


@query()
def q_dedup_fuzzy(spark, d):
    p = M.table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_type").alias("description"), F.col("p_size").cast("double").alias("lat"), F.floor(F.col("p_partkey") / 40).cast("double").alias("lng"), F.array(F.struct(F.col("p_brand").alias("start_date"))).alias("occurrences"))
    return L.dedup_fuzzy(rows)


def _tables(spark, d):
    p = M.table(spark, d, "part")
    rest = " | Hall |  | 2024-01-0{} | 7pm |  |  | desc | http://x | #A |"
    head = "| " + " | ".join(L.HEADER) + " |\n|---|\n| "
    body = F.concat(F.lit(head), "p_name", F.lit(rest.format(1)), F.lit(" x |\n| Talk | "), "p_name", F.lit(rest.format(2)), F.lit(" y |\n| broken | "), "p_brand", F.lit(" |\n| "), "p_brand", F.lit(rest.format(3)))
    return p.select("p_partkey", body.alias("body"))


@query("""select p_partkey, row_no::int as row_no, name, location, start_date, emoji from (select p_partkey, unnest([{'row_no': 2, 'name': p_name, 'start_date': '2024-01-01', 'emoji': 'x'}, {'row_no': 3, 'name': 'Talk | ' || p_name, 'start_date': '2024-01-02', 'emoji': 'y'}, {'row_no': 5, 'name': p_brand, 'start_date': '2024-01-03', 'emoji': ''}], recursive := true), 'Hall' as location from part)""")
def q_md_table_parse(spark, d):
    return L.parse_tables(_tables(spark, d)).select("p_partkey", "row_no", "name", "location", "start_date", "emoji")


@query()
def q_chunk(spark, d):
    rows = L.chunk(M.table(spark, d, "documents"), "doc_id", "text", 2000)
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.md5("chunk").alias("chunk_md5"))


@query("""with c as (select conv_id, turn, case when turn = min(turn) over (partition by conv_id) then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and not starts_with(x, '|---')), chr(10)) end as t from conversations)
select conv_id, md5(string_agg(t, chr(10) order by turn)) as text_md5 from c where t <> '' group by 1""")
def q_chunk_merge(spark, d):
    return L.merge_chunks(M.table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("text_md5"))


@query("select user_id, max(ts)::date as last_read from events group by 1 having date '2024-02-03' - max(ts)::date >= case when user_id % 2 = 0 then 3 else 7 end and user_id % 5 <> 0")
def q_recency_skip(spark, d):
    e = M.table(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("site")).agg(F.to_date(F.max("ts")).alias("last_read"))
    sites = last.select("site", (F.col("site") % 5 == 0).alias("disabled"), F.when(F.col("site") % 2 == 0, 3).alias("crawl_frequency"))
    return L.stale(sites, last, F.lit("2024-02-03").cast("date")).select(F.col("site").alias("user_id"), "last_read")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def q_output_exists(spark, d):
    return M.table(spark, d, "documents").join(M.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


LINKS = """p as (select page_id, [url, 'ftp://x/' || page_id, url || '?again', 'https://' || (page_id % 7) || '.example/', 'http:///nohost', 'http://?q'] as urls from pages),
u as (select page_id, generate_subscripts(urls, 1) - 1 as position, unnest(urls) as url from p)"""


@query(f"with {LINKS}, h as (select *, {_host} as host from u where starts_with(url, 'http://') or starts_with(url, 'https://')) select page_id, position::int as position, url from (select *, row_number() over (partition by page_id, host order by position) as r from h) where r = 1 or host = ''")
def q_hostname_links(spark, d):
    rows = M.table(spark, d, "pages")
    last = F.concat(F.lit("https://"), F.col("page_id") % 7, F.lit(".example/"))
    urls = F.array("url", F.concat(F.lit("ftp://x/"), "page_id"), F.concat("url", F.lit("?again")), last, F.lit("http:///nohost"), F.lit("http://?q"))
    return V.links(rows.select("page_id", urls.alias("urls")), "page_id", "urls")


@query(f"with {M.SQL.strip()} select loc_id, round(lat, 5) as lat, round(lng, 5) as lng, case when loc_id % 25 between 1 and 20 then (loc_id % 25)::int end as zoom, case when loc_id % 2 = 0 then date '2008-06-01' end as start_date, (case when list_contains(tags, 'UNITED STATES') then 2 else len(tags) end)::int as n_tags from loc")
def q_url_params(spark, d):
    loc = M.locations(spark, d)
    start = F.when(F.col("loc_id") % 2 == 0, F.lit("2008-06-01"))
    made = loc.select("loc_id", url.share_url("https://x.example/", F.col("lat"), F.col("lng"), F.col("loc_id") % 25, start, F.lit("2008-06-07"), F.col("tags")).alias("u"))
    got = made.select("loc_id", *(v.alias(k) for k, v in url.view_state(F.col("u")).items()))
    return got.select("loc_id", "lat", "lng", "zoom", F.col("start").alias("start_date"), F.size("tags").alias("n_tags"))


@query(f"select p_partkey, case when length(n) > 40 then n[1:35] || '…' else n end as display_name from (select p_partkey, {NAMES} as n from part)")
def q_display_name(spark, d):
    return M.table(spark, d, "part").select("p_partkey", text.display_name(F.lit(""), F.expr(NAMES)).alias("display_name"))


@query("select l_orderkey, l_linenumber, strftime(l_shipdate, '%b %-d, %Y') as day, strftime(l_shipdate, '%Y-%m-%d') as url_day from lineitem")
def q_datetime_format(spark, d):
    return M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", when.display_day(F.col("l_shipdate")).alias("day"), when.url_day(F.col("l_shipdate")).alias("url_day"))


@query("select p_partkey, case when length(n) > 40 then null else p_name || ' and <strong>' || p_brand || '</strong>' end as shown from (select *, '*' || p_name || '* and **' || p_brand || '**' as n from part)")
def q_result_name(spark, d):
    name = F.concat(F.lit("*"), "p_name", F.lit("* and **"), "p_brand", F.lit("**"))
    return M.table(spark, d, "part").select("p_partkey", text.result_name(F.lit(""), name).alias("shown"))


SECTIONS = ("view", "location", "click", "tag")


@query("""with s(section, n) as (values ('view', 0), ('location', 1), ('click', 2), ('tag', 3)), l as (select user_id, event_type, max(ts) as last_at from events group by 1, 2)
select u.user_id, string_agg(section, ' ' order by last_at nulls first, n) as sections from (select distinct user_id from events) u cross join s left join l on l.user_id = u.user_id and l.event_type = section group by 1""")
def q_section_order(spark, d):
    """Sections of each viewer, where an event of a section's name dismisses it."""
    return V.section_order(M.table(spark, d, "events"), "user_id", "event_type", "ts", SECTIONS).select("user_id", F.array_join("sections", " ").alias("sections"))


_clock = "replace(lower(replace(strftime({}, '%-I:%M %p'), ' ', '')), ':00', '')"


@query(f"""with w as (select l_orderkey as id, l_shipdate + to_hours(l_linenumber % 24) + to_minutes(l_linenumber % 2 * 30) as s, l_quantity from lineitem),
z0 as (select id, s, s + to_hours(l_quantity::int % 5) as e from w), z as (select *, {_clock.format("s")} as c, {_clock.format("e")} as f from z0),
y as (select id, s, e, case when s::date = e::date and c <> f then c || '–' || f else c end as t from z),
g as (select id, s::date as k, t, min({{'s': s, 'e': e}}) as first from y group by 1, 2, 3),
many as (select id, string_agg(day || ': ' || times, '; ' order by k) as text from (select id, k, strftime(k, '%b %-d') as day, string_agg(t, ', ' order by first) as times from g group by 1, 2) group by 1),
x as (select id, count(*) as n, min(s)::date as sd, arg_min(e, s)::date as ed, arg_min(c, s) as st, arg_min(f, s) as et from z group by 1)
select id, case when n > 1 then text else strftime(sd, '%b %-d') || ', ' || st || (case when sd <> ed then ' – ' || strftime(ed, '%b %-d') || ', ' || et when st <> et then '–' || et else '' end) end as text from x join many using (id)""")
def q_compact_dates(spark, d):
    li = M.table(spark, d, "lineitem")
    start = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber") % 24, F.col("l_linenumber") % 2 * 30)
    end = start + F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int") % 5)
    occ = li.select(F.col("l_orderkey").alias("id"), F.struct(start.alias("start"), end.alias("end"), F.lit("x").alias("start_time"), F.lit("x").alias("end_time")).alias("o"))
    return occ.groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("occ")).select("id", when.compact(F.col("occ")).alias("text"))


def _halls(spark, d):
    nation = M.table(spark, d, "nation")
    return nation.select(F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") == 0, "Hall").otherwise(F.col("n_name")).alias("name"), F.lit(None).cast("string").alias("short_name"), F.lit(None).cast("array<string>").alias("alternate_names"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lng"), F.lit("H").alias("emoji"))


def _varied(spark, d):
    """Pages of three listings at one of 25 places: the second is the first one's name with more to it, the third is another event; addresses, days, tags and emoji vary."""
    place = F.col("p_partkey") % 25
    hall = F.when(place == 0, "Hall").otherwise(F.concat(F.lit("NATION_"), place))
    day = lambda n: F.concat(F.lit("2024-01-"), F.lpad((F.col("p_partkey") % 9 + n).cast("string"), 2, "0"))
    emoji = F.when(F.col("p_partkey") % 3 == 0, "🎵").when(F.col("p_partkey") % 3 == 1, "□").otherwise("x")
    line = lambda name, n, tag: F.concat(F.lit("\n| "), name, F.lit(" | "), hall, F.lit(" |  | "), day(n), F.lit(" | 7pm |  |  | desc | https://x.example/"), F.lit(n), F.lit(" | #"), F.lit(tag), F.lit(" | "), emoji, F.lit(" |"))
    body = F.concat(F.lit("| " + " | ".join(L.HEADER) + " |\n|---|"), line(F.col("p_name"), 1, "Jazz"), line(F.concat(F.lit("Talk "), "p_name"), 2, "Talks"), line(F.col("p_brand"), 3, "Art"))
    return M.table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.lit(None).cast("array<string>").alias("extra_tags"), body.alias("body"))


@query("""with p as (select *, (p_partkey % 9)::int as k, case when p_partkey % 3 = 0 then '🎵' else 'H' end as emoji, (p_partkey % 25)::double as lat from part)
select p_partkey, p_name as name, lat, emoji, 'https://x.example/1 https://x.example/2' as urls, '2024-01-' || lpad((k + 1)::varchar, 2, '0') || ' 2024-01-' || lpad((k + 2)::varchar, 2, '0') as days, 'Jazz' as first_tag from p
union all select p_partkey, p_brand, lat, emoji, 'https://x.example/3', '2024-01-' || lpad((k + 3)::varchar, 2, '0'), 'Art' from p""")
def q_batch_plan(spark, d):
    """Pages of three listings each through the whole batch plan: placed, grouped, with the addresses and days of all rows of an event."""
    rows = staged(batch.listing_rows(_varied(spark, d), RULES, F.lit("2024-01-01").cast("date")), "rows")
    rows = rows.withColumn("row_id", F.col("file") * 100 + F.col("row_no"))
    events = batch.grouped_events(staged(batch.placed_rows(rows, _halls(spark, d), "row_id"), "placed"), "file", "row_no")
    days = F.array_join(F.transform("occurrences", lambda o: o["start_date"]), " ")
    return events.select(F.col("file").alias("p_partkey"), "name", "lat", "emoji", F.array_join("urls", " ").alias("urls"), days.alias("days"), F.get("tags", F.lit(0)).alias("first_tag"))


@query()
def q_first_emoji(spark, d):
    return M.table(spark, d, "documents").select("doc_id", text.first_emoji(F.col("text")).alias("emoji"))


@query()
def q_decode_html(spark, d):
    return M.table(spark, d, "pages").select("page_id", F.md5(text.decode_html(F.col("html"))).alias("text_md5"))


@query()
def q_emphasise(spark, d):
    """Every text; SQL has no word edges for the two rules on underscores, so the tests hold it against a plain rule."""
    return M.table(spark, d, "documents").select("doc_id", F.md5(text.emphasise(F.col("text"))).alias("text_md5"))


EXPORT = f"""e as (select p_partkey as pos, p_brand || ' end' as name, p_type as description, 40.7 + (p_partkey % 9) * 0.01 as lat, -74.0 + (p_partkey % 5) * 0.01 as lng, ['u' || (p_partkey % 4), 'u' || (p_partkey % 3), ''] as urls,
  (date '{M.AS_OF}' + (p_size % 60 - 20)::int) as day from part),
g as (select lat::double as lat, lng::double as lng, day, name, arg_min(pos, (-length(description), pos)) as pos from e where day >= date '{M.AS_OF}' and day <= date '{M.AS_OF}' + 90 group by 1, 2, 3, 4),
eu as (select *, unnest(urls) as u, generate_subscripts(urls, 1) as i from e),
l as (select g.pos, eu.u, min((eu.pos, eu.i)) as ord from g join eu on eu.lat::double = g.lat and eu.lng::double = g.lng and eu.day = g.day and eu.name = g.name where eu.u <> '' group by 1, 2),
j as (select pos, string_agg(u, ',' order by ord) as urls from l group by 1),
x as (select g.*, j.urls, lat between 40.686695 and 40.749285 and lng between -74.014855 and -73.959385 and day < date '{M.AS_OF}' + 7 as init from g join j using (pos))"""


def _export(spark, d):
    p = M.table(spark, d, "part")
    k = F.col("p_partkey")
    day = F.date_add(F.lit(M.AS_OF).cast("date"), F.col("p_size") % 60 - 20).cast("string")
    occ = F.array(F.struct(day.alias("start_date"), F.lit("").alias("start_time"), F.lit("").alias("end_date"), F.lit("").alias("end_time")))
    url = lambda n: F.concat(F.lit("u"), k % n)
    rows = p.select(k.alias("pos"), F.concat("p_brand", F.lit(" end")).alias("name"), F.col("p_type").alias("description"), (40.7 + (k % 9) * 0.01).alias("lat"), (-74.0 + (k % 5) * 0.01).alias("lng"), F.array(url(4), url(3), F.lit("")).alias("urls"), occ.alias("occurrences"))
    rows = rows.withColumns({"lat": F.round("lat", 2), "lng": F.round("lng", 2)})
    as_of = F.lit(M.AS_OF).cast("date")
    return L.split_export(staged(batch.export(rows, as_of), "export"), rows.select("lat", "lng").distinct(), as_of)


def _exported(rows):
    return rows.select("pos", "name", F.array_join("urls", ",").alias("urls"), F.col("first_start").cast("string").alias("first_start"))


@query(f"with {EXPORT} select pos, name, urls, day::varchar as first_start from x where init")
def q_export_init(spark, d):
    return _exported(_export(spark, d)[0])


@query(f"with {EXPORT} select pos, name, urls, day::varchar as first_start from x where not init")
def q_export_full(spark, d):
    return _exported(_export(spark, d)[1])


@query("select event_id, case event_type when 'click' then '#111' when 'view' then '#222' else '#444' end as colour, lower(replace(event_type || '_' || user_id, '_', ' ')) as site from events")
def q_marker_colour(spark, d):
    e = M.table(spark, d, "events")
    path = F.concat(F.lit("/crawled/20240101/"), "event_type", F.lit("_"), "user_id", F.lit(".md"))
    return e.select("event_id", V.marker_colour(F.col("event_type"), {"click": "#111", "view": "#222"}).alias("colour"), files.site_name(path).alias("site"))


@query("select s_suppkey, round((length(s_name) + length(n_name) - levenshtein(s_name, n_name))::double / (length(s_name) + length(n_name)), 9) as ratio from supplier join nation on s_nationkey = n_nationkey")
def q_edit_ratio(spark, d):
    s = M.table(spark, d, "supplier").join(M.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", F.round(geo.edit_ratio(F.col("s_name"), F.col("n_name")), 9).alias("ratio"))


@query("select event_type, count(*) as n, max(event_id) as last_id from events group by 1")
def q_stream_arrivals(spark, d):
    """Events through a file stream that stops when all has arrived, then counted."""
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    schema = M.table(spark, d, "events").schema
    stream = incremental.arrivals(spark, d, schema, name_filter="events.parquet")
    incremental.drain(stream.select("event_id", "event_type"), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("select o_orderkey, o_orderstatus as part, o_orderstatus <> 'F' as is_later, true as is_unique from orders")
def q_two_phase_load(spark, d):
    """The first part of a load and then the rest, each in batches; ids of later batches are greater, and none is there twice."""
    root = f"{shared_root(spark)}/load-{uuid.uuid4().hex}"
    orders = M.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for part in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        orders.where(part).repartition(3).write.mode("append").parquet(f"{root}/landed")
        incremental.append_batches(incremental.arrivals(spark, f"{root}/landed", orders.schema, 2), f"{root}/table")
    rows = incremental.appended(spark, f"{root}/table")
    last = rows.where("o_orderstatus = 'F'").agg(F.max("id")).first()[0]
    ids = rows.groupBy("id").agg(F.count("*").alias("_n"))
    return rows.join(ids, "id").select("o_orderkey", F.col("o_orderstatus").alias("part"), (F.col("id") > F.lit(last)).alias("is_later"), (F.col("_n") == 1).alias("is_unique"))


@query("""select name, n from (with p as (select count(*) as c from part)
  select unnest(['pages read', 'rows read', 'rows dropped', 'rows without a place']) as name, unnest([p.c, 3 * p.c, 0, 0]) as n from p)""")
def q_run_counters(spark, d):
    """What a whole run counted on its way."""
    pages = _tables(spark, d).withColumnRenamed("p_partkey", "file").withColumn("extra_tags", F.lit(None).cast("array<string>"))
    done = batch.run(pages, _halls(spark, d), RULES, F.lit("2024-01-01").cast("date"), f"{shared_root(spark)}/run-{uuid.uuid4().hex}")
    report = [(k, v) for k, v in done.report().items() if k in ("pages read", "rows read", "rows dropped", "rows without a place")]
    return spark.createDataFrame(report, "name string, n long")
