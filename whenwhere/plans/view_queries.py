"""Registered queries of the interactive side, each with its DuckDB SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cells as Z
from ..operators import search_index as S
from ..operators import signed as C
from ..operators import tag_index as T
from ..operators import view as V
from ..operators import windows as N
from ..sources.stages import shared_root, staged
from . import model as M

W = V.Weights()
STATES = V.TagStates(selected=("URGENT", "ASIA"), forbidden=("F",))
ALL = V.TagStates(required=("URGENT", "ASIA"))
NONE = V.TagStates(forbidden=("URGENT", "ASIA"))
MIXED = V.TagStates(selected=("O",), required=("HIGH",), forbidden=("EUROPE",), implicit=("AFRICA",))
CHOSEN = {"URGENT": 1.0, "ASIA": 1.0, "HIGH": 0.7}
EDGES = [("URGENT", "HIGH", 0.8), ("ASIA", "NATION_3", 0.9), ("ASIA", "NATION_8", 0.7), ("HIGH", "NATION_8", 0.9), ("HIGH", "URGENT", 0.5), ("LOW", "MEDIUM", 1.2)]
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"with {M.SQL.strip()}\n{sql.strip()}"
        return f

    return add


def _quad_sql(lat="lat", lng="lng") -> str:
    terms = []
    for (y1, x1), (y2, x2) in zip(M.QUAD, M.QUAD[-1:] + M.QUAD[:-1], strict=True):
        terms.append(f"(case when (({y1}::double > {lat}) <> ({y2}::double > {lat})) and {lng} < {x2 - x1!r}::double * ({lat} - {y1}::double) / {y2 - y1!r}::double + {x1}::double then 1 else 0 end)")
    return "(" + " + ".join(terms) + ") % 2 = 1"


def _windowed(spark, d):
    return V.on_dates(M.event_rows(spark, d), M.occurrence_rows(spark, d), M.moment(M.START), M.moment(M.END))


@query(f"""select id, loc_id, count(*) as n_matching from ev join occ using (id) where s <= timestamp '{M.END}' and e >= timestamp '{M.START}' group by 1, 2""")
def q_interval_overlap(spark, d):
    return _windowed(spark, d).select("id", "loc_id", F.size("matching_occurrences").cast("long").alias("n_matching"))


@query(f"""select id from ev where id in (select id from occ where s <= timestamp '{M.APP_END}' and e >= timestamp '{M.APP_START}')""")
def q_app_range(spark, d):
    hit = M.occurrence_rows(spark, d).where((F.col("start") <= M.moment(M.APP_END)) & (F.col("end") >= M.moment(M.APP_START)))
    return M.event_rows(spark, d).join(hit.select("id"), "id", "left_semi").select("id")


def _tagged(spark, d, states):
    loc = M.locations(spark, d)
    met = M.events(spark, d).join(loc.select("loc_id", F.col("tags").alias("place")), "loc_id")
    return met.where(V.matches(V.all_tags(F.col("tags"), F.col("place")), states)).select("id", "loc_id")


@query("select id, loc_id from evl where list_has_any(both_tags, ['URGENT', 'ASIA']) and not list_contains(both_tags, 'F')")
def q_tag_filter_any(spark, d):
    return _tagged(spark, d, STATES)


@query("select id, loc_id from evl where list_has_all(both_tags, ['URGENT', 'ASIA'])")
def q_tag_filter_all(spark, d):
    return _tagged(spark, d, ALL)


@query("select id, loc_id from evl where not list_has_any(both_tags, ['URGENT', 'ASIA'])")
def q_tag_filter_none(spark, d):
    return _tagged(spark, d, NONE)


@query("select id, loc_id from evl where list_contains(both_tags, 'HIGH') and not list_contains(both_tags, 'EUROPE')")
def q_tag_filter_mixed(spark, d):
    return _tagged(spark, d, MIXED)


@query("select id, loc_id from evl where list_contains(both_tags, 'HIGH') and not list_contains(tags, 'EUROPE')")
def q_list_filter(spark, d):
    return V.by_tags(M.events(spark, d), M.locations(spark, d), MIXED).select("id", "loc_id")


@query("select id from evl where list_has_any(list_transform(place, lambda x: lower(x)), ['asia', 'europe'])")
def q_geotag_filter(spark, d):
    from .view import in_geotags

    return in_geotags(M.events(spark, d), M.locations(spark, d), ("Asia", "EUROPE")).select("id")


def _first_start(spark, d):
    return M.events(spark, d).withColumn("first_start", F.get("occurrences", F.lit(0))["start"].cast("date"))


def _split(spark, d, stage=lambda events: events):
    from ..operators.listing import split_export

    loc = M.locations(spark, d)
    ev = _first_start(spark, d).join(loc.select("loc_id", "lat", "lng"), "loc_id")
    return split_export(stage(ev), loc, F.lit(M.AS_OF).cast("date"))


SPLIT = f"""firsts as (select ev.id, ev.loc_id, min(s)::date as f from ev join occ using (id) group by 1, 2),
init as (select * from firsts where loc_id in (select loc_id from box) and f < date '{M.AS_OF}' + 7), rest as (select * from firsts where id not in (select id from init)),
r5 as (select loc_id, round(lat, 5) as a, round(lng, 5) as b from loc), li as (select distinct a, b from r5 where loc_id in (select loc_id from init)), lr as (select distinct a, b from r5 where loc_id in (select loc_id from rest))"""


@query()
def q_bbox_split_init(spark, d):
    return _split(spark, d)[0].select("id", "loc_id")


@query()
def q_bbox_split_full(spark, d):
    return _split(spark, d)[1].select("id", "loc_id")


@query()
def q_locations_active(spark, d):
    return _split(spark, d)[2].select("loc_id")


@query()
def q_locations_full_only(spark, d):
    return _split(spark, d)[3].select("loc_id")


_head = f"with {M.SQL.strip()},\n{SPLIT}\n"
ORACLE["q_bbox_split_init"] = _head + "select id, loc_id from init"
ORACLE["q_bbox_split_full"] = _head + "select id, loc_id from rest"
ORACLE["q_locations_active"] = _head + "select loc_id from r5 join li using (a, b)"
ORACLE["q_locations_full_only"] = _head + "select loc_id from r5 join lr using (a, b) where (a, b) not in (select (a, b) from li)"


@query(f"select id, loc_id from evw join loc using (loc_id) where {_quad_sql()}")
def q_viewport_quad(spark, d):
    return V.in_view(_windowed(spark, d), M.locations(spark, d), M.QUAD).select("id", "loc_id")


@query("select loc_id, round(d, 3) as distance_m, round(greatest(0.0, 5.0 * (1 - d / 20000.0)), 6) as bonus from dist")
def q_distance(spark, d):
    rows = V.distances(M.locations(spark, d), *M.CENTER)
    return rows.select("loc_id", F.round("distance", 3).alias("distance_m"), F.round(geo.proximity_bonus(F.col("distance"), 5.0, 20000.0), 6).alias("bonus"))


@query("select tag, count(distinct loc_id) as frequency from (select loc_id, unnest(tags) as tag from ev union all select loc_id, unnest(tags) from loc) group by 1")
def q_tag_frequency(spark, d):
    return V.tag_frequency(M.events(spark, d), M.locations(spark, d))


VOC = "voc as (select distinct tag from (select unnest(tags) as tag from ev union all select unnest(tags) from loc))"


@query()
def q_dynamic_frequency(spark, d):
    ev, loc = M.events(spark, d), M.locations(spark, d)
    return V.dynamic_frequency(_windowed(spark, d), V.vocabulary(ev, loc))


ORACLE["q_dynamic_frequency"] = f"with {M.SQL.strip()},\n{VOC}\nselect tag, coalesce(n, 0) as frequency from voc left join (select tag, count(distinct loc_id) as n from (select loc_id, unnest(tags) as tag from evw) group by 1) using (tag)"


@query(f"select tag, round(sum(1 + greatest(0.0, 1 - d / 20000.0)), 6) as weight from (select loc_id, unnest(tags) as tag from evw) join dist using (loc_id) join loc using (loc_id) where {_quad_sql()} group by 1")
def q_visible_facets(spark, d):
    loc = M.locations(spark, d)
    seen = V.in_view(_windowed(spark, d), loc, M.QUAD)
    return V.visible_facets(seen, V.distances(loc, *M.CENTER)).select("tag", F.round("weight", 6).alias("weight"))


@query("select distinct tag from (select unnest(tags) as tag from ev union all select unnest(tags) from loc)")
def q_vocabulary(spark, d):
    return V.vocabulary(M.events(spark, d), M.locations(spark, d))


@query("select tag, count(*) as n_events, min(id) as first_id, max(id) as last_id from (select distinct id, unnest(both_tags) as tag from evl where id in (select id from win)) group by 1")
def q_tag_index(spark, d):
    return V.tag_index(_windowed(spark, d), M.locations(spark, d))


def _written_tags(spark, d):
    pairs = V.tag_places(M.events(spark, d), M.locations(spark, d))
    return T.write(pairs.select("tag", "id"), M.events(spark, d).select("id"), f"{shared_root(spark)}/tags-{uuid.uuid4().hex}")


@query("select tag, cast(count(*) as bigint) as n_events, min(id) as first_id, max(id) as last_id from (select distinct id, unnest(both_tags) as tag from evl) group by 1")
def q_tag_index_written(spark, d):
    return _written_tags(spark, d).stats()


@query("""select 'any' as filter, id from evl where list_has_any(both_tags, ['URGENT', 'ASIA']) and not list_contains(both_tags, 'F')
  union all select 'all', id from evl where list_has_all(both_tags, ['URGENT', 'ASIA']) union all select 'none', id from evl where not list_has_any(both_tags, ['URGENT', 'ASIA'])
  union all select 'mixed', id from evl where list_contains(both_tags, 'HIGH') and not list_contains(both_tags, 'EUROPE') union all select 'free', id from evl""")
def q_tag_index_filters(spark, d):
    """The filters by tag states, from the written index alone."""
    index = _written_tags(spark, d)
    found = [index.matching(s).withColumn("filter", F.lit(n)) for n, s in (("any", STATES), ("all", ALL), ("none", NONE), ("mixed", MIXED), ("free", V.TagStates()))]
    return functools.reduce(DataFrame.unionByName, found).select("filter", "id")


@query("""select d.day, count(*) as n_occurrences, count(distinct id) as n_events from (select distinct date_trunc('day', o_orderdate) as day from orders) d
  join occ on s <= d.day + interval 6 days and e >= d.day group by 1""")
def q_many_windows(spark, d):
    """The week from each day on which an order was made, all at once."""
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    days = M.table(spark, d, "orders").select(day.alias("from")).distinct().withColumn("to", F.col("from") + F.make_dt_interval(F.lit(6)))
    met = N.overlapping(M.occurrence_rows(spark, d), days)
    return met.groupBy(F.col("from").alias("day")).agg(F.count("*").alias("n_occurrences"), F.countDistinct("id").alias("n_events"))


def _cells(spark, d):
    return Z.write(M.locations(spark, d), f"{shared_root(spark)}/places-{uuid.uuid4().hex}")


@query(f"select loc_id, round(d, 3) as distance_m from dist join loc using (loc_id) where {_quad_sql()}")
def q_view_cells(spark, d):
    """The places that a view shows, from the table clustered by cell."""
    return V.distances(_cells(spark, d).in_view(M.QUAD), *M.CENTER).select("loc_id", F.round("distance", 3).alias("distance_m"))


@query("select loc_id, round(d, 3) as distance_m from dist where d <= 4000")
def q_near_places(spark, d):
    return _cells(spark, d).near(*M.CENTER, 4000.0).select("loc_id", F.round("distance", 3).alias("distance_m"))


@query()
def q_facets_moved(spark, d):
    """Facets of a window that got there by three moves, each counted by what it changed."""
    ev, occ = M.event_rows(spark, d), M.occurrence_rows(spark, d)
    facets = C.Facets.start(spark, f"{shared_root(spark)}/facets-{uuid.uuid4().hex}")
    for first, last in (("1998-05-20 00:00:00", "1998-05-26 23:59:59.999"), ("1998-05-24 00:00:00", "1998-06-12 23:59:59.999"), (M.START, M.END)):
        facets = facets.at(ev, occ, (M.moment(first), M.moment(last)))
    return facets.frequency(V.vocabulary(M.events(spark, d), M.locations(spark, d)))


ORACLE["q_facets_moved"] = ORACLE["q_dynamic_frequency"]


def _sets(spark, d, windowed=None):
    loc = V.distances(M.locations(spark, d), *M.CENTER)
    matching = V.by_tags(_windowed(spark, d) if windowed is None else windowed, loc, V.TagStates(selected=("URGENT", "ASIA")))
    visible = loc.where(geo.in_quad(F.col("lat"), F.col("lng"), M.QUAD))
    return loc, matching, visible


_tag_sql = lambda c: " + ".join(f"(case when list_contains({c}, '{t}') then {w * W.multi_tag!r}::double else 0 end)" for t, w in CHOSEN.items())
MATCH = f"""mat as (select id, loc_id from evl where id in (select id from win) and list_has_any(both_tags, ['URGENT', 'ASIA'])),
vis as (select loc_id from loc where {_quad_sql()}),
sl as (select loc_id, name, loc_id in (select loc_id from mat) as is_matching, loc_id in (select loc_id from vis) as is_visible,
    1 + (case when loc_id in (select loc_id from mat) then 10.0::double else 0 end) + {_tag_sql("tags")} + greatest(0.0::double, 5.0::double * (1 - d / 20000.0::double)) + (case when loc_id in (select loc_id from vis) then 5.0::double else 0 end) as score
  from loc join dist using (loc_id)),
fo as (select id, min(s) as s, arg_min(e, (s, e)) as e from occ group by 1),
tb as (select id, greatest(0.0::double, 5.0::double * (1 - (case when s <= timestamp '{M.START}' and e >= timestamp '{M.START}' then greatest(0.0::double, abs(epoch_us(s) - epoch_us(timestamp '{M.START}'))::double / 86400000000.0::double - 5)
    else abs(epoch_us(s) - epoch_us(timestamp '{M.START}'))::double / 86400000000.0::double end) / 30.0::double)) as bonus from fo),
se as (select id, evl.loc_id, id in (select id from mat) as is_matching, evl.loc_id in (select loc_id from vis) as is_visible,
    1 + (case when id in (select id from mat) then 10.0::double else 0 end) + {_tag_sql("both_tags")} + greatest(0.0::double, 5.0::double * (1 - d / 20000.0::double)) + bonus + (case when evl.loc_id in (select loc_id from vis) then 5.0::double else 0 end) as score
  from evl join dist using (loc_id) join tb using (id)),
{VOC},
dy as (select tag, count(distinct loc_id) as n from (select loc_id, unnest(tags) as tag from ev where id in (select id from mat)) group by 1),
vf as (select tag, sum(1 + greatest(0.0, 1 - d / 20000.0)) as w from (select loc_id, unnest(tags) as tag from evw where loc_id in (select loc_id from vis)) join dist using (loc_id) group by 1),
fq as (select tag, count(distinct loc_id) as n from (select loc_id, unnest(tags) as tag from ev union all select loc_id, unnest(tags) from loc) group by 1),
st as (select tag, vf.w is not null as is_visible, coalesce(dy.n, 0) + (case when lower(tag) = 'asia' then 1000.0::double else 0 end) + (case when vf.w is not null then 5 * vf.w + 5 else 0 end) + 0.01::double * coalesce(fq.n, 0) as score
  from voc left join dy using (tag) left join vf using (tag) left join fq using (tag))"""
_search = lambda sql: f"with {M.SQL.strip()},\n{MATCH}\n{sql}"


@query()
def q_search_locations(spark, d):
    loc, matching, visible = _sets(spark, d)
    return V.search_locations(loc, matching, visible, CHOSEN, W).select("loc_id", "is_matching", "is_visible", F.round("score", 6).alias("score"))


ORACLE["q_search_locations"] = _search("select loc_id, is_matching, is_visible, round(score, 6) as score from sl")


@query()
def q_search_events(spark, d):
    loc, matching, visible = _sets(spark, d)
    rows = V.search_events(M.events(spark, d), loc, matching, visible, CHOSEN, M.moment(M.START), W)
    return rows.select("id", "loc_id", "is_matching", "is_visible", F.round("score", 6).alias("score"))


ORACLE["q_search_events"] = _search("select id, loc_id, is_matching, is_visible, round(score, 6) as score from se")


def _named_events(spark, d, events):
    """Events with their place's and nation's names in their texts, as listings have them."""
    loc = M.locations(spark, d).select("loc_id", F.col("name").alias("location"), F.get("tags", F.lit(0)).alias("sublocation"))
    return events.join(loc, "loc_id")


def _held(spark, d):
    """Events and those of the window, each gathered once: a search reads them for its index, its counts and its results."""
    return staged(M.events(spark, d), "events"), staged(_windowed(spark, d), "windowed")


def _index(spark, d, events=None):
    events = staged(M.events(spark, d).drop("occurrences"), "events") if events is None else events
    ev, loc = _named_events(spark, d, events), M.locations(spark, d)
    path = f"{shared_root(spark)}/search-{uuid.uuid4().hex}"
    return S.write(V.searchable_entries(ev, loc, V.vocabulary(ev, loc)), path)


def _tag_results(spark, d, term, ev, windowed, geotags=(), found=None):
    loc, matching, visible = _sets(spark, d, windowed)
    words = V.vocabulary(ev, loc)
    facets = V.visible_facets(windowed.join(visible.select("loc_id"), "loc_id", "left_semi"), loc)
    return V.search_tags(words, V.dynamic_frequency(matching, words), facets, V.tag_frequency(ev, loc), term, W, geotags, found)


@query()
def q_search_tags(spark, d):
    ev, windowed = _held(spark, d)
    return _tag_results(spark, d, "Asia", ev, windowed, found=_index(spark, d, ev).find("Asia")).select("tag", "is_visible", F.round("score", 6).alias("score"))


@query()
def q_search_tags_no_term(spark, d):
    """Geotags are no results without a term."""
    return _tag_results(spark, d, "", *_held(spark, d), ("asia", "nation_1", "europe")).select("tag", "is_visible", F.round("score", 6).alias("score"))


ORACLE["q_search_tags_no_term"] = _search("select tag, is_visible, round(score - (case when lower(tag) = 'asia' then 1000.0::double else 0 end), 6) as score from st where lower(tag) not in ('asia', 'nation_1', 'europe')")
ORACLE["q_search_tags"] = _search("select tag, is_visible, round(score, 6) as score from st where contains(lower(tag), 'asia')")


def results(spark, d, term=None):
    """All three kinds of result in one table: type, ref, is_visible, score."""
    ev, windowed = _held(spark, d)
    loc, matching, visible = _sets(spark, d, windowed)
    found = _index(spark, d, ev).find(term) if term else None
    tags = _tag_results(spark, d, term or "", ev, windowed, found=found)
    return V.perform_search(ev, loc, matching, visible, tags, CHOSEN, M.moment(M.START), W, term, found).withColumn("score", F.round("score", 6))


@query()
def q_grouped_topk(spark, d):
    return V.grouped_top(results(spark, d), 100).select("type", "ref", "hidden", "rank", "score")


ORACLE["q_grouped_topk"] = _search("""select type, ref, hidden, cast(rank as int) as rank, score from (select *, row_number() over (partition by type, hidden order by score desc, ref) as rank from (
  select 'location' as type, loc_id::varchar as ref, not is_visible as hidden, round(score, 6) as score from sl
  union all select 'event', id::varchar, not is_visible, round(score, 6) from se
  union all select tag_t, tag, not is_visible, round(score - (case when lower(tag) = 'asia' then 1000.0::double else 0 end), 6) from (select 'tag' as tag_t, * from st))) where rank <= 100""")


@query()
def q_popup_rank(spark, d):
    _, matching, _ = _sets(spark, d)
    m = matching.select("id").withColumn("_m", F.lit(1))
    rows = M.events(spark, d).join(m, "id", "left").withColumn("is_matching", F.col("_m").isNotNull())
    return V.popup_rank(rows, ("URGENT", "O"), M.moment(M.START)).select("loc_id", "id", F.col("place").cast("long").alias("place"), "is_open")


ORACLE["q_popup_rank"] = _search(f"""select loc_id, id, place, is_matching or n_here < 4 or place = 1 as is_open from (select *, row_number() over (partition by loc_id order by is_matching desc, chosen desc, gap, id) as place, count(*) over (partition by loc_id) as n_here from (
  select ev.loc_id, ev.id, ev.id in (select id from mat) as is_matching, len(list_intersect(ev.tags, ['URGENT', 'O'])) as chosen, g.gap from ev join
  (select id, min(case when s <= timestamp '{M.START}' and e >= timestamp '{M.START}' then 0.0::double else abs(epoch_us(s) - epoch_us(timestamp '{M.START}'))::double end) as gap from occ group by 1) g using (id)))""")


@query()
def q_related_expand(spark, d):
    edges = spark.createDataFrame(EDGES, "tag string, related string, weight double")
    words = V.vocabulary(M.events(spark, d), M.locations(spark, d))
    chosen = words.where(F.col("tag").isin("URGENT", "ASIA", "HIGH"))
    return V.related(edges, chosen).join(words, "tag", "left_semi")


ORACLE["q_related_expand"] = f"with {M.SQL.strip()},\n{VOC}, e(tag, related, weight) as (values {', '.join(f'({a!r}, {b!r}, {c}::double)' for a, b, c in EDGES)}), c as (select tag from voc where tag in ('URGENT', 'ASIA', 'HIGH'))\nselect tag, 1.0::double as weight from c union all select related, max(weight) from e where tag in (select tag from c) and related not in (select tag from c) and related in (select tag from voc) group by 1 having max(weight) < 1"


@query("select o_orderkey as id, o_orderstatus as part from orders where o_orderstatus = 'F' union all select o_orderkey + (select count(*) from orders where o_orderstatus = 'F'), o_orderstatus from orders where o_orderstatus <> 'F'")
def q_append_union(spark, d):
    o = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("part"))
    return V.append(o.where("part = 'F'"), o.where("part <> 'F'"))


@query("select loc_id, rank from (select loc_id, cast(row_number() over (order by lat, lng, loc_id) as int) as rank from loc where loc_id in (select loc_id from evw)) where rank <= 1000")
def q_marker_limit(spark, d):
    return V.first_markers(V.with_matches(M.locations(spark, d), _windowed(spark, d))).select("loc_id", "rank")


@query(f"select id, loc_id from evl where id in (select id from win) and list_has_any(list_transform(place, lambda x: lower(x)), ['asia', 'europe']) and list_has_any(both_tags, ['URGENT', 'ASIA']) and not list_contains(tags, 'F')")
def q_apply_filters(spark, d):
    from .view import apply_filters

    return apply_filters(M.events(spark, d), M.locations(spark, d), STATES, M.moment(M.START), M.moment(M.END), geotags=("ASIA", "Europe")).select("id", "loc_id")


@query("select loc_id, count(*) as n_events, min(id) as first_id from evw group by 1")
def q_group_by_location(spark, d):
    from .view import by_location

    return by_location(_windowed(spark, d))


@query("select loc_id from (select loc_id, row_number() over (partition by ((loc_id * 37) % 200) // 10, ((loc_id * 53) % 199) // 10 order by loc_id) as r from loc) where r = 1")
def q_first_places(spark, d):
    from .view import first_places

    coarse = lambda k, n: F.floor((F.col("loc_id") * k % n) / 10).cast("double")  # noqa: E731  places that share coordinates
    rows = M.locations(spark, d).select("loc_id", coarse(37, 200).alias("lat"), coarse(53, 199).alias("lng"))
    return first_places(rows, "loc_id").select("loc_id")


@query("""select l_orderkey as id, count(*) as n, min(epoch_us(d + m) + epoch_us(timezone('America/New_York', d + interval 12 hour)) - epoch_us(d + interval 12 hour)) as first_us from
  (select l_orderkey, l_shipdate::date::timestamp as d, to_minutes((l_linenumber % 24) * 60) as m from lineitem) group by 1""")
def q_parsed_occurrences(spark, d):
    from .view import parsed_occurrences

    li = M.table(spark, d, "lineitem")
    day = F.to_date("l_shipdate").cast("string")
    time = F.date_format(F.timestamp_seconds((F.col("l_linenumber") % 24) * 3600), "ha")
    raw = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(day.alias("start_date"), time.alias("start_time"), F.lit("").alias("end_date"), F.lit("").alias("end_time"))).alias("o"))
    rows = raw.select("id", parsed_occurrences(F.col("o")).alias("o"))
    return rows.select("id", F.size("o").cast("long").alias("n"), F.unix_micros(F.get("o", F.lit(0))["start"]).alias("first_us"))


_text = lambda *c: f"lower(strip_accents(array_to_string(list_filter([{', '.join(c)}], lambda x: x <> ''), ' ')))"
INDEX = f"""ie as (select id, {_text("ev.name", "l.name", "l.tags[1]")} as text from ev join loc l using (loc_id)),
il as (select loc_id, {_text("name", "short_name", "tags[1]", "tags[2]")} as text from loc),
ia as (select 'event' as type, id::varchar as ref, text from ie union all select 'location', loc_id::varchar, text from il union all select 'tag', tag, lower(strip_accents(tag)) from voc)"""


@query(f"select type, ref, md5(text) as text_md5 from (with {VOC}, {INDEX} select * from ia)")
def q_search_index(spark, d):
    """What the written index holds of each entry."""
    return _index(spark, d).texts.select("type", "ref", F.md5("text").alias("text_md5"))


#: Terms with an accent, of one and two characters, longer than a gram, with a space, in a tag's whole length, and in no text.
TERMS = ("Natión_1", "úR", "u", "tomer#00000001", "middle EAST", "Asia", "ent customer", "no such thing")


@query(f"select w.term, type, ref, w.form = text as is_whole from (with {VOC}, {INDEX} select * from ia) i join (values {', '.join(f'({t!r}, {S.term_form(t)!r})' for t in TERMS)}) w(term, form) on contains(text, form)")
def q_search_terms(spark, d):
    index = _index(spark, d)
    found = [index.find(t).withColumn("term", F.lit(t)) for t in TERMS]
    return functools.reduce(DataFrame.unionByName, found)


@query()
def q_perform_search(spark, d):
    """A term that events, places and a tag hold, with an accent and capitals."""
    return results(spark, d, "Natión_1")


ORACLE["q_perform_search"] = _search("""select 'location' as type, loc_id::varchar as ref, is_visible, round(score, 6) as score from sl where loc_id in (select loc_id from il where contains(text, 'nation_1'))
  union all select 'event', id::varchar, is_visible, round(score, 6) from se where id in (select id from ie where contains(text, 'nation_1'))
  union all select 'tag', tag, is_visible, round(score - (case when lower(tag) = 'asia' then 1000.0::double else 0 end) + (case when lower(tag) = 'nation_1' then 1000.0::double else 0 end), 6) from st where contains(lower(tag), 'nation_1')""").replace(VOC, f"{VOC},\n{INDEX}")


@query()
def q_search_results(spark, d):
    """Without a term: what matches or is seen, the selected place first, no tags that are chosen already."""
    return V.grouped_top(results(spark, d, ""), 50, "", selected="37", states=MIXED).select("type", "ref", "hidden", "rank", "score")


ORACLE["q_search_results"] = _search("""select type, ref, hidden, cast(rank as int) as rank, score from (select *, row_number() over (partition by type, hidden order by (type = 'location' and not hidden and ref = '37') desc, score desc, ref) as rank from (
  select 'location' as type, loc_id::varchar as ref, not is_visible as hidden, round(score, 6) as score from sl where is_visible or is_matching
  union all select 'event', id::varchar, not is_visible, round(score, 6) from se where is_visible or is_matching
  union all select 'tag', tag, not is_visible, round(score - (case when lower(tag) = 'asia' then 1000.0::double else 0 end), 6) from st where tag not in ('O', 'HIGH', 'EUROPE'))) where rank <= 50""")


@query("select loc_id, list_filter(tags, lambda t: lower(t) not in ('asia', 'europe')) as tags from (select loc_id, tags from loc where loc_id in (select loc_id from evw))")
def q_header_tags(spark, d):
    return V.header_tags(V.with_matches(M.locations(spark, d), _windowed(spark, d)), ("asia", "europe")).select("loc_id", "tags")


@query()
def q_select_tags(spark, d):
    ev, loc = M.events(spark, d), M.locations(spark, d)
    wanted = M.table(spark, d, "nation").select(F.explode(F.array("n_name", F.initcap("n_name"), F.concat("n_name", F.lit("x")))).alias("wanted"))
    return V.select_tags(V.vocabulary(ev, loc), wanted)


ORACLE["q_select_tags"] = f"with {M.SQL.strip()},\n{VOC}, w as (select n_name as wanted, n_name as tag from nation union all select array_to_string(list_transform(string_split(n_name, ' '), lambda x: x[1] || lower(x[2:])), ' '), n_name from nation)\nselect wanted, tag from w where tag in (select tag from voc)"


def q_flagship(spark, d):
    """The view's answer: visible or matching events of the window with their places, best first."""
    loc, matching, visible = _sets(spark, d)
    rows = V.search_events(V.in_dates(M.events(spark, d), M.moment(M.START), M.moment(M.END)), loc, matching, visible, CHOSEN, M.moment(M.START), W).where("is_visible or is_matching")
    return rows.join(loc.select("loc_id", F.col("name").alias("place")), "loc_id").select("id", "place", "tags", "is_matching", "is_visible", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(100)
