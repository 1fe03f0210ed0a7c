"""Queries for dimensional models, history, change capture, table writes and enrichment."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import modeling as m
from ..operators.cdc import append_changes, cdc_log, replayed
from ..operators.enrich import api_enrich
from ..operators.ingest import Extractor, add_partitions, export_documents, ingest, replace_documents
from ..operators.lineage import RunContext, lineage_event
from ..session import materialize, scratch
from ..sources import table
from ..sources.embedded import archived
from ..sources.readers import jdbc, jdbc_options
from ..sources.store import TableStore
from . import Registry
from .relational import money, user_orders

REGISTRY = query = Registry()


# star


@query("star_dim_customer", "select cast(c_custkey as varchar) as user_id, c_name, c_mktsegment, 1 as rows_of_key from customer")
def star_dim_customer(spark: SparkSession, folder: str) -> DataFrame:
    dim = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), "c_name", "c_mktsegment")
    return _keyed(dim, "user_id")


def _keyed(dim: DataFrame, key: str) -> DataFrame:
    """A dimension with the number of rows that share its surrogate key, found by joining on it."""
    keyed = dim.withColumn("_sk", m.surrogate(F.col(key)))
    sizes = keyed.groupBy("_sk").agg(F.count(F.lit(1)).cast("int").alias("rows_of_key"))
    return keyed.join(sizes, "_sk").drop("_sk")


@query("star_dim_part", "select cast(p_partkey as varchar) as product_id, p_name, p_brand, 1 as rows_of_key from part")
def star_dim_part(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed(table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("product_id"), "p_name", "p_brand"), "product_id")


_CALENDAR = """cast(year(date) * 10000 + month(date) * 100 + day(date) as int) as date_key, cast(year(date) as int) as year, cast(month(date) as int) as month, cast(day(date) as int) as day,
  cast(quarter(date) as int) as quarter, cast(dayofweek(date) + 1 as int) as weekday, cast(year(date) * 100 + month(date) as int) as year_month,
  cast(case when month(date) < 4 then year(date) - 1 else year(date) end as int) as fiscal_year, date = last_day(date) as is_month_end"""


@query("star_dim_date", f"select date, {_CALENDAR} from (select distinct cast(o_orderdate as date) as date from orders)")
def star_dim_date(spark: SparkSession, folder: str) -> DataFrame:
    return m.dim_date(table(spark, folder, "orders"), "o_orderdate")


@query("star_fact_orders", """
select o_orderkey, l_linenumber, cast(c_custkey as varchar) as user_id, cast(p_partkey as varchar) as product_id, cast(l_extendedprice as decimal(18,2)) as amount
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey""")
def star_fact_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Facts joined with both dimensions by their surrogate keys; the natural keys are read back for the check."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    users = table(spark, folder, "customer").select(m.surrogate(F.col("c_custkey")).alias("customer_sk"), F.col("c_custkey").cast("string").alias("user_id"))
    parts = table(spark, folder, "part").select(m.surrogate(F.col("p_partkey")).alias("product_sk"), F.col("p_partkey").cast("string").alias("product_id"))
    keyed = lines.join(orders, "l_orderkey").withColumns({"customer_sk": m.surrogate(F.col("o_custkey")), "product_sk": m.surrogate(F.col("l_partkey"))})
    return keyed.join(users, "customer_sk").join(parts, "product_sk").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "user_id", "product_id", money("l_extendedprice").alias("amount"))


@query("wide_star_reconcile", "select cast(null as bigint) as l_orderkey, cast(null as int) as l_linenumber, cast(null as varchar) as only_in where false")
def wide_star_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """No row: the lines of all customers, with customer, part and amount, are the same in the wide table and in the star."""
    return _differences(spark, folder, lambda star: star)


_STAR = """(select l_orderkey, l_linenumber, o_custkey, l_partkey, cast(l_extendedprice as decimal(18,2)) as amount
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey)"""


@query("wide_star_reconcile_planted", f"""
select l_orderkey, l_linenumber, 'a' as only_in from {_STAR} where l_orderkey % 50 in (7, 9)
union all select l_orderkey, l_linenumber, 'b' from {_STAR} where l_orderkey % 50 = 9""")
def wide_star_reconcile_planted(spark: SparkSession, folder: str) -> DataFrame:
    """What the reconciliation says of a star that lost the lines of some orders and has wrong amounts in others."""
    wrong = F.when(F.col("l_orderkey") % 50 == 9, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)")
    return _differences(spark, folder, lambda star: star.filter("l_orderkey % 50 <> 7").withColumn("amount", wrong))


def _differences(spark: SparkSession, folder: str, change) -> DataFrame:
    line = ["l_orderkey", "l_linenumber"]
    wide = user_orders(spark, folder).select(*line, F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("product_id"), money("l_extendedprice").alias("amount"))
    star = star_fact_orders(spark, folder).withColumnRenamed("o_orderkey", "l_orderkey")
    return m.reconcile(wide, change(star)).select(*line, "only_in")


# writes

_V2 = """(select c_custkey, case when c_custkey % 10 = 0 then 'CHANGED' else c_mktsegment end as c_mktsegment from customer where c_custkey % 17 <> 0
  union all select c_custkey + 10000000, c_mktsegment from customer where c_custkey % 100 = 1)"""


def versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A master and a later state of it: every tenth row changed, every seventeenth gone, some new."""
    v1 = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    changed = v1.filter("c_custkey % 17 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    return v1, changed.unionByName(v1.filter("c_custkey % 100 = 1").withColumn("c_custkey", F.col("c_custkey") + 10000000))


@query("merge_upsert", f"select * from customer_v2 union all select c_custkey, c_mktsegment from customer where c_custkey not in (select c_custkey from customer_v2)".replace("customer_v2", _V2))
def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    v1, v2 = versions(spark, folder)
    store = TableStore(spark, scratch(spark, "store"))
    store.create(v1, "customer")
    store.merge(v2, "customer", ["c_custkey"])
    return store.read("customer")


@query("merge_update_only", f"select c.c_custkey, coalesce(v.c_mktsegment, c.c_mktsegment) as c_mktsegment from customer c left join {_V2} v on c.c_custkey = v.c_custkey")
def merge_update_only(spark: SparkSession, folder: str) -> DataFrame:
    v1, v2 = versions(spark, folder)
    store = TableStore(spark, scratch(spark, "store"))
    store.create(v1, "customer")
    store.merge_update(v2, "customer", ["c_custkey"], {"c_mktsegment": F.col("source.c_mktsegment")})
    return store.read("customer")


@query("overwrite_partitions", """
select c_custkey, c_acctbal, c_mktsegment from customer where c_mktsegment <> 'BUILDING' union all select c_custkey, 0.0, c_mktsegment from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0""")
def overwrite_partitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    store = TableStore(spark, scratch(spark, "store"))
    store.create(rows, "customer", ["c_mktsegment"])
    fresh = store.read("customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 0").withColumn("c_acctbal", F.lit(0.0))
    store.overwrite_partitions(fresh, "customer", require="c_mktsegment")
    return store.read("customer")


@query("store_sweep", "select 2 as removed, count(*) as rows from region")
def store_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots that nothing shows any more are removed; the table stays."""
    store = TableStore(spark, scratch(spark, "store"))
    for _ in range(3):
        store.create(table(spark, folder, "region"), "region")
    removed = store.sweep("region", buffer_s=0)
    return store.read("region").agg(F.lit(removed).alias("removed"), F.count(F.lit(1)).alias("rows"))


@query("document_replace", """
select strftime(cast(ts as date), '%Y-%m-%d') || '-' || user_id as _id, count(*) as orders from events group by cast(ts as date), user_id, 1""")
def document_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of an environment's collection, each replaced by a later and complete count."""
    store = TableStore(spark, scratch(spark, "documents"))
    counts = lambda rows: rows.groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.count(F.lit(1)).alias("orders"))
    events = table(spark, folder, "events")
    replace_documents(store, counts(events.filter("event_id % 2 = 0")), ["date", "user_id"], "rankings", "dev")
    name = replace_documents(store, counts(events), ["date", "user_id"], "rankings", "dev")
    return store.read(name).select("_id", F.get_json_object("value", "$.orders").cast("bigint").alias("orders"))


@query("jdbc_partitioned_scan", "select c_mktsegment, count(*) as rows, sum(c_custkey) as keys from customer where c_acctbal > 0 group by 1")
def jdbc_partitioned_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A subquery read in four partitions from a database that all executors reach."""
    most, balance = sys.float_info.max, F.col("c_acctbal")
    held = F.when(balance > most, most).when(balance < -most, -most).otherwise(balance)  # the engine has no infinities and no NaN, which is above all numbers
    rows = table(spark, folder, "customer").select("c_custkey", held.alias("c_acctbal"), "c_mktsegment")
    url = archived(rows, "customer", {"c_custkey": "bigint", "c_acctbal": "double", "c_mktsegment": "varchar(32672)"})
    pushed = 'select "c_custkey", "c_mktsegment" from customer where "c_acctbal" > 0'
    rows = jdbc(spark, jdbc_options(pushed, '"c_custkey"', "1", "100000", url))
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys"))


@query("append_rows", "select r_regionkey, r_name, cast(null as int) as version from region union all select r_regionkey + 100, r_name, 2 from region")
def append_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The second write brings a new column."""
    region = table(spark, folder, "region")
    store = TableStore(spark, scratch(spark, "store"))
    store.create(region, "region")
    store.append(region.withColumns({"r_regionkey": F.col("r_regionkey") + 100, "version": F.lit(2)}), "region")
    return store.read("region")


@query("branch_isolation", """
select 'main' as branch, count(*) as rows from customer union all select 'dev', count(*) from customer where c_acctbal > 0 union all select 'clone', 0""")
def branch_isolation(spark: SparkSession, folder: str) -> DataFrame:
    """Writes on a branch and on an empty clone leave the main table as it was."""
    rows = table(spark, folder, "customer")
    store = TableStore(spark, scratch(spark, "store"))
    store.create(rows, "customer")
    store.branch("customer", "dev")
    store.create(rows.filter("c_acctbal > 0"), "customer", branch="dev")
    store.clone_empty("customer", "dev_customer")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("branch"), "rows")
    return count("main", store.read("customer")).unionByName(count("dev", store.read("customer", "dev"))).unionByName(count("clone", store.read("dev_customer")))


# history and change


@query("scd2_customer", f"""
with v2 as {_V2}, base as (select c_custkey, c_mktsegment, date '2020-01-01' as s from customer)
select b.c_custkey, b.c_mktsegment, s as effective_start_date, case when v.c_mktsegment <> b.c_mktsegment then date '2024-02-01' else date '9999-12-31' end as effective_end_date,
  not coalesce(v.c_mktsegment <> b.c_mktsegment, false) as is_current from base b left join v2 v on b.c_custkey = v.c_custkey
union all select v.c_custkey, v.c_mktsegment, date '2024-02-01', date '9999-12-31', true from v2 v left join base b on b.c_custkey = v.c_custkey where b.c_custkey is null or v.c_mktsegment <> b.c_mktsegment""")
def scd2_customer(spark: SparkSession, folder: str) -> DataFrame:
    v1, v2 = versions(spark, folder)
    current = v1.select("*", F.lit("2020-01-01").cast("date").alias("effective_start_date"), F.lit("9999-12-31").cast("date").alias("effective_end_date"), F.lit(True).alias("is_current"))
    return m.scd2_apply(current, v2, "c_custkey", ["c_mktsegment"], "2024-02-01")


@query("scd2_no_overlap", """
with d as (select distinct * from dim_fund), o as (select *, lag(coalesce(effective_end_date, date '9999-12-31')) over (partition by fund_id order by effective_start_date, effective_end_date) as before from d)
select fund_id, effective_start_date, before is null or effective_start_date >= before as no_overlap from o""")
def scd2_no_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return m.overlap_flags(table(spark, folder, "dim_fund").distinct(), "fund_id").select("fund_id", "effective_start_date", "no_overlap")


@query("calendar_gap_fill", f"select date, {_CALENDAR} from (select distinct cast(ts as date) as date from events) where date not in (select ingest_date from fund_master_v2)")
def calendar_gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    return m.calendar_fill(table(spark, folder, "events"), "ts", table(spark, folder, "fund_master_v2"), "ingest_date")


def nav_series(spark: SparkSession, folder: str) -> DataFrame:
    """A price series per event type: the day's values added up."""
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("fund_id"), F.to_date("ts").alias("base_date")).agg(F.sum(money("value")).cast("double").alias("nav"))


NAV_SQL = "nav as (select event_type as fund_id, cast(ts as date) as base_date, cast(sum(cast(value as decimal(18,2))) as double) as nav from events group by 1, 2)"


@query("incremental_fact", f"""
with {NAV_SQL}, lagged as (select *, lag(nav) over (partition by fund_id order by base_date) as previous from nav)
select fund_id, base_date, nav, previous, round(nav - previous, 6) as change, round((nav - previous) / previous * 100, 6) as change_pct from lagged where base_date > date '2024-01-15'""")
def incremental_fact(spark: SparkSession, folder: str) -> DataFrame:
    nav = nav_series(spark, folder)
    rows = m.incremental_fact(nav, nav.filter("base_date <= date '2024-01-15'"), "fund_id", "base_date", "nav")
    return rows.withColumns({"change": F.round("change", 6), "change_pct": F.round("change_pct", 6)})


@query("cdc_changelog", f"""
with v2 as {_V2}, j as (select coalesce(a.c_custkey, b.c_custkey) as c_custkey, a.c_mktsegment as was, b.c_mktsegment as now, a.c_custkey is not null as old, b.c_custkey is not null as new
  from customer a full join v2 b on a.c_custkey = b.c_custkey)
select c_custkey, 1 as version, 'I' as op, new and was is not distinct from now as is_current, was as c_mktsegment from j where old
union all select c_custkey, case when old then 2 else 1 end, case when not old then 'I' when not new then 'D' else 'U' end, true, now from j where not old or not new or was is distinct from now""")
def cdc_changelog(spark: SparkSession, folder: str) -> DataFrame:
    v1, v2 = versions(spark, folder)
    return cdc_log(v1, v2, "c_custkey", ["c_mktsegment"])


@query("cdc_replay", f"select * from {_V2}")
def cdc_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A log of three snapshots played back gives the last of them."""
    v1, v2 = versions(spark, folder)
    log = materialize(cdc_log(v1, v1.filter("c_custkey % 5 <> 0"), "c_custkey", ["c_mktsegment"]), "cdc")
    return replayed(append_changes(log, v2, "c_custkey", ["c_mktsegment"]), "c_custkey", ["c_mktsegment"])


@query("fund_wide", """
select m.fund_id, m.ingest_date, m.fund_name, d.effective_start_date, d.trust_fee_rate as dim_fee from fund_master_v2 m join (select distinct * from dim_fund where is_current) d on m.fund_id = d.fund_id""")
def fund_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with their dimension's current version."""
    dim = table(spark, folder, "dim_fund").distinct().filter("is_current").select("fund_id", "effective_start_date", F.col("trust_fee_rate").alias("dim_fee"))
    return table(spark, folder, "fund_master_v2").select("fund_id", "ingest_date", "fund_name").join(dim, "fund_id")


# enrichment and rankings


@query("geo_enrich", """
select u.user_id, u.zip_code, t.municipality, t.latitude from users u left join taxonomy_jp_hierarchy t on u.zip_code = t.zip_code""")
def geo_enrich(spark: SparkSession, folder: str) -> DataFrame:
    geo = table(spark, folder, "taxonomy_jp_hierarchy").select("zip_code", "municipality", "latitude")
    return m.geo_enrich(table(spark, folder, "users").select("user_id", "zip_code"), geo, "zip_code")


def _weather(rows: list[dict]) -> dict:
    """Stands in for a weather service: a function of the key that knows nothing of every seventh."""
    return {r["event_id"]: {"temperature": float(r["event_id"] % 40 - 5)} for r in rows if r["event_id"] % 7}


@query("weather_enrich_stub", """
select event_id, case when event_id % 7 = 0 then -1.0 else cast(event_id % 40 - 5 as double) end as temperature, event_id % 7 = 0 as _dlq from events""")
def weather_enrich_stub(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id")
    return api_enrich(rows, "event_id", _weather, "event_id bigint, temperature double, _dlq boolean", chunk=1000, rate=1_000_000, dead={"temperature": -1.0})


@query("context_features", """
select user_id, cast(ts as date) as day, round(sum(value), 4) as total, count(distinct event_id) as orders, bool_or(event_type = 'error') as any_flag, max(value) as top_reading,
  case when bool_or(event_type = 'error') or max(value) > 480 then true else false end as any_condition from events group by 1, 2""")
def context_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), "value", F.col("event_id").alias("order_id"), (F.col("event_type") == "error").alias("flag"), F.col("value").alias("reading"))
    out = m.context_features(rows, "user_id", "day", "value", "flag", "reading")
    return out.withColumns({"total": F.round("total", 4), "any_condition": m.any_of(F.col("any_flag"), F.col("top_reading") > 480)})


@query("daily_ranking", """
with t as (select cast(ts as date) as date, user_id, count(*) as orders, sum(cast(value as decimal(18,2))) as total, max(value) as largest from events where ts >= timestamp '2024-01-20' - interval 24 hour group by 1, 2)
select date, user_id, orders, cast(total as double) as total, largest, cast(row_number() over (partition by date order by total desc, user_id) as int) as rank from t qualify rank <= 100""")
def daily_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return m.daily_ranking(table(spark, folder, "events"), "user_id", "ts", "value", "2024-01-20", top=100).withColumn("total", F.col("total").cast("double"))


@query("top10_latest_window", """
with w as (select user_id, time_bucket(interval 30 minute, ts) as start, sum(cast(value as decimal(18,2))) as total from events group by 1, 2),
l as (select * from w qualify row_number() over (partition by user_id order by start desc) = 1)
select user_id, strftime(start, '%Y-%m-%d %H:%M:%S') as start, cast(total as double) as total, cast(row_number() over (order by total desc, user_id) as int) as rank from l qualify rank <= 10""")
def top10_latest_window(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's newest window, found by an aggregate instead of a join with the maximum; then the ten largest."""
    windows = table(spark, folder, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.sum(money("value")).alias("total"))
    latest = windows.groupBy("user_id").agg(F.max(F.struct(F.col("w.start").alias("start"), "total")).alias("l")).select("user_id", "l.*")
    top = m.top_numbered(latest, [F.col("total").desc(), F.col("user_id")], 10)
    return top.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.col("total").cast("double").alias("total"), "rank")


@query("monthly_top_user", """
select month, user_id, cast(revenue as double) as revenue from (select *, row_number() over (partition by month order by revenue desc, user_id) as rn from (
  select cast(date_trunc('month', o_orderdate) as date) as month, o_custkey as user_id, sum(cast(o_totalprice as decimal(18,2))) as revenue from orders group by 1, 2)) where rn = 1""")
def monthly_top_user(spark: SparkSession, folder: str) -> DataFrame:
    return m.monthly_top(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_totalprice").withColumn("revenue", F.col("revenue").cast("double"))


@query("ctas_month_base", """
select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue from orders group by 1""")
def ctas_month_base(spark: SparkSession, folder: str) -> DataFrame:
    """An aggregate stored as a table partitioned by month, read back."""
    rows = table(spark, folder, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.sum(money("o_totalprice")).cast("double").alias("revenue"))
    store = TableStore(spark, scratch(spark, "store"))
    store.create(rows, "month_base", ["month"])
    return store.read("month_base")


@query("materialized_daily", "select cast(ts as date) as day, count(*) as events, count(distinct user_id) as users from events group by 1")
def materialized_daily(spark: SparkSession, folder: str) -> DataFrame:
    """A stored view, made from part of the data and refreshed once."""
    define = lambda rows: rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))
    events = table(spark, folder, "events")
    store = TableStore(spark, scratch(spark, "store"))
    store.create(define(events.filter("event_id % 2 = 0")), "daily")
    store.create(define(events), "daily")
    return store.read("daily")


@query("latest_row_per_key", """
select fund_id, ingest_date, fund_name from (select *, row_number() over (partition by fund_id order by ingest_date desc, load_seq desc) as rn from fund_master_v2) where rn = 1""")
def latest_row_per_key(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("fund_id").orderBy(F.col("ingest_date").desc(), F.col("load_seq").desc())
    return table(spark, folder, "fund_master_v2").withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("fund_id", "ingest_date", "fund_name")


# ingestion and export


@query("ingest_bronze", """
select delivery_no, user_id, case when not isnan(subtotal_usd) then subtotal_usd end as subtotal, date '2025-03-10' as ingest_date, user_id is not null as user_id_hash
from orders_microbatch_window_raw where created_at >= timestamp '2025-03-10' and created_at < timestamp '2025-03-11'""")
def ingest_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """One logical date loaded twice into the same partition; the second load replaces the first."""
    source = table(spark, folder, "orders_microbatch_window_raw").select("delivery_no", "user_id", "subtotal_usd", "created_at")
    load = lambda _: ingest(source, "2025-03-10", "user_id", "created_at", "2025-03-10", {"subtotal_usd": "subtotal"}, ("subtotal",))
    store = TableStore(spark, scratch(spark, "store"))
    for _ in range(2):
        Extractor(load, "orders").run(spark, store)
    return store.read("orders").select("delivery_no", "user_id", "subtotal", "ingest_date", F.col("user_id_hash").isNotNull().alias("user_id_hash"))


@query("external_partitions", "select event_type, count(*) as n from events group by 1")
def external_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet by day registered in the catalog, read through it."""
    name = f"tide_events_{uuid.uuid4().hex[:8]}"
    rows = table(spark, folder, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    add_partitions(rows, name, scratch(spark, "external"), "day")
    return spark.table(name).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("document_export", """
with t as (select cast(ts as date) as date, user_id, count(*) as orders from events group by 1, 2)
select strftime(date, '%Y-%m-%d') || '-' || user_id as _id, user_id, orders from t""")
def document_export(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts as documents keyed by date and user, read back."""
    rows = table(spark, folder, "events").groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.count(F.lit(1)).alias("orders"))
    path = scratch(spark, "documents")
    export_documents(rows, ["date", "user_id"], path)
    return spark.read.schema("_id string, user_id bigint, orders bigint").json(path)


@query("view_definition", "select user_id, sum(value) > 1000 as busy from events group by 1")
def view_definition(spark: SparkSession, folder: str) -> DataFrame:
    """A named view over a table, queried with SQL."""
    name = f"v_{uuid.uuid4().hex[:8]}"
    table(spark, folder, "events").select("user_id", "value").createOrReplaceTempView(name)
    return spark.sql(f"select user_id, sum(value) > 1000 as busy from {name} group by user_id")


@query("inline_values", "select code, label, count(u.user_id) as users from (values ('store', 'shop'), ('web', 'online')) r(code, label) left join users u on u.acquisition_channel = r.code group by 1, 2")
def inline_values(spark: SparkSession, folder: str) -> DataFrame:
    """A relation of literals joined with a table."""
    labels = spark.sql("select * from values ('store', 'shop'), ('web', 'online') as r(code, label)")
    users = table(spark, folder, "users").select(F.col("acquisition_channel").alias("code"), "user_id")
    return labels.join(users, "code", "left").groupBy("code", "label").agg(F.count("user_id").alias("users"))


@query("lineage_of_a_plan")
def lineage_of_a_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The event that a run of a query on the main branch reports."""
    df = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    event = lineage_event("orders_by_user", df, "user_orders", RunContext(ingest_date="2025-01-01"))
    return spark.createDataFrame([(event,)], "event string")
