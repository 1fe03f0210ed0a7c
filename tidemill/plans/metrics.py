"""Queries for the semantic layer, returns and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as x
from ..sources import table
from . import Registry
from .modeling import NAV_SQL, nav_series

REGISTRY = query = Registry()

ABV_SQL = f"""with {NAV_SQL}, d as (select *, lag(nav) over (partition by fund_id order by base_date) as previous from nav), r as (select * from d where previous is not null),
abv as (select fund_id, base_date, nav, nav - previous as diff, previous as denominator_day,
  case when row_number() over (partition by fund_id, date_trunc('month', base_date) order by base_date) = 1 then previous end as denominator_month,
  case when row_number() over (partition by fund_id, date_trunc('year', base_date) order by base_date) = 1 then previous end as denominator_year from r)"""
UNIFIED_SQL = ABV_SQL + """,
unified as (select fund_id, base_date as period, 'day' as grain, sum(diff) as numerator, sum(denominator_day) as denominator from abv group by 1, 2
union all select fund_id, cast(date_trunc('month', base_date) as date), 'month', sum(diff), sum(denominator_month) from abv group by 1, 2
union all select fund_id, cast(date_trunc('year', base_date) as date), 'year', sum(diff), sum(denominator_year) from abv group by 1, 2)"""


def abv(spark: SparkSession, folder: str) -> DataFrame:
    return x.fund_abv(nav_series(spark, folder), "fund_id", "base_date", "nav")


@query("semantic_abv_daily", ABV_SQL + " select fund_id, base_date, round(diff, 6) as diff, denominator_day, denominator_month, denominator_year from abv")
def semantic_abv_daily(spark: SparkSession, folder: str) -> DataFrame:
    return abv(spark, folder).select("fund_id", "base_date", F.round("diff", 6).alias("diff"), "denominator_day", "denominator_month", "denominator_year")


@query("semantic_unified", UNIFIED_SQL + " select fund_id, period, grain, round(numerator, 4) as numerator, round(denominator, 4) as denominator from unified")
def semantic_unified(spark: SparkSession, folder: str) -> DataFrame:
    out = x.fund_unified(abv(spark, folder), "fund_id", "base_date")
    return out.withColumns({"numerator": F.round("numerator", 4), "denominator": F.round("denominator", 4)})


def cube(spark: SparkSession, folder: str) -> x.Cube:
    """Measures of the unified table; the return of a fund or of all funds is a ratio of sums."""
    return x.Cube(
        x.fund_unified(abv(spark, folder), "fund_id", "base_date"),
        {"return": x.Measure("numerator", "denominator"), "return_pct": x.Measure("numerator", "denominator", percent=True)},
        {"fund": F.col("fund_id"), "period": F.col("period")},
        {g: F.col("grain") == g for g in ("day", "month", "year")},
    )


@query("metric_return_month", UNIFIED_SQL + " select fund_id as fund, period, round(sum(numerator) / nullif(sum(denominator), 0) * 100, 6) as return_pct from unified where grain = 'month' group by 1, 2")
def metric_return_month(spark: SparkSession, folder: str) -> DataFrame:
    return cube(spark, folder).query(["return_pct"], ["fund", "period"], "month").withColumn("return_pct", F.round("return_pct", 6))


@query("metric_return_year", UNIFIED_SQL + """ select period, round(sum(numerator) / nullif(sum(denominator), 0), 8) as "return" from unified where grain = 'year' and fund_id <> 'error' group by 1""")
def metric_return_year(spark: SparkSession, folder: str) -> DataFrame:
    return cube(spark, folder).query(["return"], ["period"], "year", [F.col("fund_id") != "error"]).withColumn("return", F.round("return", 8))


@query("return_gross_month", f"with {NAV_SQL} select fund_id, cast(date_trunc('month', base_date) as date) as month, round(arg_max(nav, base_date) - arg_min(nav, base_date), 4) as gross from nav group by 1, 2")
def return_gross_month(spark: SparkSession, folder: str) -> DataFrame:
    return x.gross_return_month(nav_series(spark, folder), "fund_id", "base_date", "nav").withColumn("gross", F.round("gross", 4))


@query("return_net_month", f"""with {NAV_SQL}, d as (select *, lag(nav) over (partition by fund_id order by base_date) as previous from nav)
select fund_id, cast(date_trunc('month', base_date) as date) as month, round(sum(nav - previous - previous * (length(fund_id) * 0.1 / 100) / 365), 4) as net from d where previous is not null group by 1, 2""")
def return_net_month(spark: SparkSession, folder: str) -> DataFrame:
    nav = nav_series(spark, folder)
    fees = nav.select("fund_id").distinct().withColumn("fee", F.length("fund_id") * 0.1)
    return x.net_return_month(nav, "fund_id", "base_date", "nav", fees, "fee").withColumn("net", F.round("net", 4))


@query("psi_segments", """
with o as (select c_mktsegment as s, count(*) / sum(count(*)) over () as share from customer group by 1), r(s, share) as (values ('AUTOMOBILE', 0.26), ('BUILDING', 0.20), ('FURNITURE', 0.30), ('MACHINERY', 0.24), ('GARDEN', 0.0)),
j as (select coalesce(o.s, r.s) as segment, least(greatest(coalesce(o.share, 0), 1e-9), 1 - 1e-9) as b, least(greatest(coalesce(r.share, 0), 1e-9), 1 - 1e-9) as r from o full join r on o.s = r.s)
select segment, round((b - r) * ln(b / r), 6) as term, round(sum((b - r) * ln(b / r)) over (), 6) as psi from j""")
def psi_segments(spark: SparkSession, folder: str) -> DataFrame:
    observed = x.shares(table(spark, folder, "customer").withColumnRenamed("c_mktsegment", "segment"), "segment")
    reference = spark.createDataFrame([("AUTOMOBILE", 0.26), ("BUILDING", 0.20), ("FURNITURE", 0.30), ("MACHINERY", 0.24), ("GARDEN", 0.0)], "segment string, share double")
    return x.psi(observed, reference, "segment")
