"""Queries over the order messages: duplicates, late rows, rolling totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import accept_all, mark_duplicates
from ..operators.late import PeriodTotals, replay, usable
from ..operators.rolling import IDLE, rolling_totals
from ..session import scratch
from ..sources import table
from . import Registry

REGISTRY = query = Registry()

_KEY = """
  regexp_replace(lower(trim(translate(ID, '０１２３４５６７８９ａｂｃｄｅｆＡＢＣＤＥＦ－｛｝：　', '0123456789abcdefABCDEF-{}: '))), '^urn:uuid:|[{}\\- ]', '', 'g')
"""
MARKED_SQL = f"""
with normal as (
  select *, case when {_KEY} = '' or ID is null then 'row ' || delivery_no else {_KEY} end as message
  from orders_microbatch_window_raw),
marked as (
  select *, row_number() over (partition by message order by ingest_ts nulls last, delivery_no) = 1 as kept from normal)
"""
LATE_SQL = MARKED_SQL + """,
tops as (
  select ingest_ts, max(case when created_at <= ingest_ts then created_at end) as top
  from orders_microbatch_window_raw where ingest_ts is not null group by ingest_ts),
marks as (
  select ingest_ts, max(top) over (order by ingest_ts rows between unbounded preceding and 1 preceding) - interval 2 hour as wm from tops),
judged as (
  select m.*, coalesce(date_trunc('hour', created_at) + interval 1 hour <= wm, false) as late
  from marked m left join marks using (ingest_ts) where kept and created_at <= ingest_ts)
"""


def cents(amount: str) -> Column:
    """An amount in whole cents; null and NaN are no amount."""
    value = F.when(~F.isnan(amount), F.col(amount))
    return F.round(value * 100).cast("bigint")


def marked(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders_microbatch_window_raw").select("delivery_no", "ID", "user_id", "created_at", "ingest_ts", cents("total_usd").alias("cents"))
    return mark_duplicates(rows, "ID", "ingest_ts", "delivery_no")


@query("p6_found", MARKED_SQL + "select delivery_no from marked where not kept")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders_microbatch_window_raw").select("delivery_no", "ID", "ingest_ts")
    return accept_all(rows, "ID", "ingest_ts", "delivery_no")[0].filter("not kept").select("delivery_no")


@query("p6_messages", MARKED_SQL + """
select delivery_no, user_id, product_id, quantity, status_flag, cast(created_at as varchar) as created_at from marked where kept""")
def p6_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The table with one row of each message."""
    rows = table(spark, folder, "orders_microbatch_window_raw").select("delivery_no", "ID", "user_id", "product_id", "quantity", "status_flag", "created_at", "ingest_ts")
    kept = accept_all(rows, "ID", "ingest_ts", "delivery_no")[0].filter("kept")
    return kept.select("delivery_no", "user_id", "product_id", "quantity", "status_flag", F.col("created_at").cast("string").alias("created_at"))


def _numbered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events as messages of twenty producers that count without gaps and send every number twice."""
    text = F.concat(F.lit("device-"), (F.col("event_id") % 20).cast("string"), F.lit(":"), F.floor(F.col("event_id") / 40).cast("string"))
    rows = table(spark, folder, "events").select(text.alias("message"), F.col("ts").cast("timestamp_ntz").alias("at"), "event_id")
    return accept_all(rows, "message", "at", "event_id")


@query("p6_sequences", """
select event_id, row_number() over (partition by event_id % 20, event_id // 40 order by ts nulls last, event_id) = 1 as kept from events""")
def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with producer sequences, of which ranges are kept instead of keys."""
    return _numbered(spark, folder)[0].select("event_id", "kept")


@query("p6_ranges", """
with n as (select distinct event_id % 20 as p, event_id // 40 as n from events), g as (select p, n, n - row_number() over (partition by p order by n) as island from n)
select 'device-' || p || ':' as producer, min(n) as lo, max(n) as hi from g group by p, island""")
def p6_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The ranges that are left as state when all those messages were taken in."""
    return _numbered(spark, folder)[1]


def _store(spark: SparkSession, folder: str) -> PeriodTotals:
    rows = marked(spark, folder).select("delivery_no", "created_at", "ingest_ts", "cents", "kept")
    last = table(spark, folder, "orders_microbatch_window_raw").agg(F.max(F.to_date("ingest_ts"))).first()[0]
    return replay(PeriodTotals(spark, scratch(spark, "p2-store")), rows, last_day=last)


@query("p2_found", LATE_SQL + "select delivery_no from judged where late")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).retained().filter("status = 'late'").select("delivery_no")


@query("p2_hourly", LATE_SQL + """
select strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:00:00') as hour, count(*) as orders,
  cast(coalesce(sum(cast(round(case when not isnan(total_usd) then total_usd end * 100) as bigint)), 0) as double) / 100 as total_usd
from judged where not late group by 1""")
def p2_hourly(spark: SparkSession, folder: str) -> DataFrame:
    totals = _store(spark, folder).totals()
    return totals.select(F.date_format("hour", "yyyy-MM-dd HH:00:00").alias("hour"), "orders", (F.coalesce("cents", F.lit(0)).cast("double") / 100).alias("total_usd"))


_W = "over (partition by user_id order by day range between interval {n} day preceding and current row)"
_SELECTS = ", ".join(
    f"cast(coalesce(sum(cents) {w}, 0) as double) / 100 as sum_{n}, "
    f"case when sum(n) {w} > 0 then cast(coalesce(sum(cents) {w}, 0) as double) / 100 / cast(sum(n) {w} as double) end as avg_{n}, "
    f"cast(min(least) {w} as double) / 100 as min_{n}, cast(max(most) {w} as double) / 100 as max_{n}, cast(coalesce(sum(n) {w}, 0) as bigint) as orders_{n}"
    for n in (7, 30)
    for w in [_W.format(n=n - 1)]
)


@query("p7_rolling", MARKED_SQL + f""",
amounts as (
  select user_id, cast(created_at as date) as day, cast(round(case when not isnan(total_usd) then total_usd end * 100) as bigint) as cents
  from marked where kept and user_id is not null and created_at <= ingest_ts),
daily as (select user_id, day, sum(cents) as cents, count(cents) as n, min(cents) as least, max(cents) as most from amounts group by all),
top as (select max(cast(created_at as date)) as high from orders_microbatch_window_raw where created_at <= ingest_ts),
spans as (select user_id, day as low, least(coalesce(lead(day) over (partition by user_id order by day) - 1, high), day + {IDLE}, high) as high from daily, top),
spine as (select user_id, cast(unnest(generate_series(low, high, interval 1 day)) as date) as day from spans),
dense as (select s.user_id, s.day, cents, coalesce(n, 0) as n, least, most from spine s left join daily d on s.user_id = d.user_id and s.day = d.day)
select user_id, day, {_SELECTS} from dense""")
def p7_rolling(spark: SparkSession, folder: str) -> DataFrame:
    clock = usable("created_at", "ingest_ts")
    last = table(spark, folder, "orders_microbatch_window_raw").filter(clock).agg(F.max(F.to_date("created_at")))
    rows = marked(spark, folder).filter("kept").filter(clock).select("user_id", F.to_date("created_at").alias("day"), "cents")
    return rolling_totals(rows, "user_id", "day", "cents", last)
