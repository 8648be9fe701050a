"""Events and places out of the given tables: customers are places, orders events, their line items occurrences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-01"
START, END = "1998-06-01 00:00:00", "1998-06-07 23:59:59.999"
APP_START, APP_END = "1998-01-01 00:00:00", "1998-12-31 23:59:59.999"
CENTER = (40.71799, -73.98712)
QUAD = [(40.68, -74.03), (40.75, -74.02), (40.76, -73.95), (40.69, -73.96)]


def moment(text: str):
    return F.lit(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).replace(tzinfo=None)).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("c_custkey")
    lat = F.lit(40.6) + ((k * 37) % 200).cast("double") / F.lit(1000.0)
    lng = F.lit(-74.1) + ((k * 53) % 199).cast("double") / F.lit(1000.0)
    return rows.select(k.alias("loc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("short_name"), F.array("n_name", "r_name").alias("tags"), lat.alias("lat"), lng.alias("lng"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("loc_id"), F.array(F.expr("substr(o_orderpriority, 3)"), F.col("o_orderstatus")).alias("tags"), F.col("o_orderpriority").alias("name"))


def occurrence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    days = F.make_dt_interval(F.col("l_quantity").cast("int") % 5)
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp_ntz").alias("start"), (F.col("l_shipdate").cast("timestamp_ntz") + days).alias("end"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with at least one occurrence, occurrences by start. An order's lines are few, so the arrays are small."""
    occ = occurrence_rows(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("occurrences"))
    return event_rows(spark, sf_dir).join(occ, "id")


SQL = f"""
loc as (select c_custkey as loc_id, c_name as name, c_mktsegment as short_name, [n_name, r_name] as tags,
    40.6::double + ((c_custkey * 37) % 200)::double / 1000.0::double as lat, -74.1::double + ((c_custkey * 53) % 199)::double / 1000.0::double as lng
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
occ as (select l_orderkey as id, l_shipdate as s, l_shipdate + to_days((cast(l_quantity as int) % 5)::int) as e from lineitem),
ev as (select o_orderkey as id, o_custkey as loc_id, [substr(o_orderpriority, 3), o_orderstatus] as tags, o_orderpriority as name
  from orders where o_orderkey in (select id from occ)),
win as (select distinct id from occ where s <= timestamp '{END}' and e >= timestamp '{START}'),
evw as (select * from ev where id in (select id from win)),
evl as (select ev.*, loc.tags as place, list_distinct(list_concat(ev.tags, loc.tags)) as both_tags, lat, lng from ev join loc using (loc_id)),
dist as (select loc_id, 6371000.0::double * 2 * atan2(sqrt(a), sqrt(1 - a)) as d from (select loc_id, pow(sin(radians({CENTER[0]}::double - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians({CENTER[0]}::double)) * pow(sin(radians({CENTER[1]}::double - lng) / 2), 2) as a from loc)),
box as (select loc_id from loc where lat between 40.686695::double and 40.749285::double and lng between (-74.014855)::double and (-73.959385)::double)
"""
