"""Queries for scans, projections, filters, joins, aggregates, windows, top-k, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import modeling as m
from ..session import scratch
from ..sources import table
from ..sources.names import alias_renamed, nan_to_null, sanitized
from ..sources.pdf import pdf_files, written
from ..sources.readers import csv, day_predicate, json_rows, json_text, paired_lines, typed, wire_payload
from . import Registry
from .funds import alias_rules

REGISTRY = query = Registry()

MONEY = "decimal(18,2)"


def money(column: str):
    return F.col(column).cast(MONEY)


def user_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line with its order, part and customer; lines without match stay."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderstatus")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return lines.join(orders, "l_orderkey", "left").join(parts, "l_partkey", "left").join(users, "o_custkey", "left")


@query("flagship_user_sales", """
select o_custkey as user_id, c_name as user_name, count(l_orderkey) as lines, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sales
from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey group by 1, 2""")
def flagship_user_sales(spark: SparkSession, folder: str) -> DataFrame:
    rows = user_orders(spark, folder).groupBy(F.col("o_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return rows.agg(F.count("l_orderkey").alias("lines"), F.sum(money("l_extendedprice")).cast("double").alias("sales"))


@query("wide_table_left_joins", """
select l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderstatus, p_name, p_brand, c_name, c_mktsegment, cast(l_quantity as bigint) as quantity, cast(o_orderdate as date) as order_created_at
from lineitem left join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey left join customer on o_custkey = c_custkey""")
def wide_table_left_joins(spark: SparkSession, folder: str) -> DataFrame:
    return user_orders(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "o_orderstatus", "p_name", "p_brand", "c_name", "c_mktsegment",
        F.col("l_quantity").cast("bigint").alias("quantity"), F.to_date("o_orderdate").alias("order_created_at"),
    )


@query("incremental_extract", "select o_orderkey, o_custkey, o_orderstatus from orders where cast(o_orderdate as date) = date '1996-03-15'")
def incremental_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").filter(day_predicate("o_orderdate", "1996-03-15")).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("nan_to_null_clean", """
select user_id, count(*) as rows, count(case when not isnan(subtotal_usd) then subtotal_usd end) as subtotals, count(case when not isnan(tax_usd) then tax_usd end) as taxes
from orders_microbatch_window_raw group by 1""")
def nan_to_null_clean(spark: SparkSession, folder: str) -> DataFrame:
    clean = nan_to_null(table(spark, folder, "orders_microbatch_window_raw"), ["subtotal_usd", "tax_usd"])
    return clean.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count("subtotal_usd").alias("subtotals"), F.count("tax_usd").alias("taxes"))


@query("csv_roundtrip_scan", "select zip_code, prefecture, municipality, chome, latitude from taxonomy_jp_hierarchy")
def csv_roundtrip_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Written as delimited text and read with a schema that keeps leading zeros."""
    path = scratch(spark, "csv")
    columns = table(spark, folder, "taxonomy_jp_hierarchy").select("zip_code", "prefecture", "municipality", "chome", "latitude")
    columns.write.option("header", True).csv(path)
    return csv(spark, path, columns.schema)


@query("csv_all_string_typed", """
select n_nationkey, n_name, n_regionkey from nation""")
def csv_all_string_typed(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, folder, "nation").write.option("header", True).csv(path)
    return typed(csv(spark, path), {"n_nationkey": "int", "n_regionkey": "int"})


@query("sanitize_columns", """
select fund_id, "投資信託_分類" as fund_category, "信託報酬_率" as trust_fee_rate, "ファンド名" as "ファンド名", ingest_date from legacy_fund_master""")
def sanitize_columns(spark: SparkSession, folder: str) -> DataFrame:
    odd = table(spark, folder, "legacy_fund_master").withColumnsRenamed({"投資信託_分類": "投資信託・（分類）", "信託報酬_率": "信託報酬/率"})
    clean = sanitized(odd, {"投資信託_分類": "fund_category", "信託報酬_率": "trust_fee_rate"})
    return clean.select("fund_id", "fund_category", "trust_fee_rate", "ファンド名", "ingest_date")


@query("alias_rename", """
select fund_id, "投資信託_分類" as fund_category, "信託報酬_率" as trust_fee_rate, "有効レコード" as is_active, "ファンド名" as fund_name, "愛称" as nickname,
  "運用会社" as management_company, "隠れコスト" as hidden_cost, "内部戦略コード", ingest_date as some_date from legacy_fund_master""")
def alias_rename(spark: SparkSession, folder: str) -> DataFrame:
    return alias_renamed(table(spark, folder, "legacy_fund_master"), alias_rules(spark, folder))


@query("filter_projection", """
select o_orderkey, case when o_totalprice >= 200000 then 'large' when o_totalprice >= 50000 then 'middle' else 'small' end as size, 'orders' as source, cast(o_totalprice as decimal(18,2)) as total
from orders where o_orderstatus in ('F', 'P') and o_custkey is not null and o_orderdate >= timestamp '1998-01-02 00:00:00' - interval 24 hour and o_orderdate < timestamp '1999-01-01 00:00:00'""")
def filter_projection(spark: SparkSession, folder: str) -> DataFrame:
    total, at = F.col("o_totalprice"), F.col("o_orderdate")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = table(spark, folder, "orders").filter(F.col("o_orderstatus").isin("F", "P") & F.col("o_custkey").isNotNull() & (at >= day("1998-01-01")) & (at < day("1999-01-01")))
    size = F.when(total >= 200000, "large").when(total >= 50000, "middle").otherwise("small")
    return rows.select("o_orderkey", size.alias("size"), F.lit("orders").alias("source"), money("o_totalprice").alias("total"))


@query("not_in_and_semi", """
select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45) and p_brand in (select p_brand from part where p_size > 45)""")
def not_in_and_semi(spark: SparkSession, folder: str) -> DataFrame:
    """NOT IN over a column without nulls is an anti join, which needs no null-aware single task."""
    parts, lines = table(spark, folder, "part"), table(spark, folder, "lineitem")
    sold = lines.filter("l_quantity > 45 and l_partkey is not null").select(F.col("l_partkey").alias("p_partkey"))
    big = parts.filter("p_size > 45").select("p_brand")
    return parts.join(sold, "p_partkey", "left_anti").join(big, "p_brand", "left_semi").select("p_partkey", "p_name")


@query("json_flatten", """
select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """JSON text parsed by a declared schema, nested and flattened again."""
    rows = table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint").alias("x"))
    text = json_text(rows)
    return json_rows(text, "value", "event_id bigint, x struct<k:bigint>").select("event_id", "x.*")


@query("wire_format_payload", "select event_id, event_type from events")
def wire_format_payload(spark: SparkSession, folder: str) -> DataFrame:
    """A five-byte header put before each message and taken off again."""
    framed = table(spark, folder, "events").select("event_id", F.concat(F.unhex(F.lit("0000000007")), F.encode("event_type", "utf-8")).alias("value"))
    return framed.select("event_id", F.decode(wire_payload(F.col("value")), "utf-8").alias("event_type"))


@query("line_pairs_wrangle", """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
p as (select doc_id, trim(ls[1], ' ') as header, trim(ls[3], ' ') as value from l union all select doc_id, trim(ls[2], ' '), trim(ls[4], ' ') from l union all select doc_id, trim(ls[5], ' '), trim(ls[6], ' ') from l)
select * from p where header is not null and header <> ''""")
def line_pairs_wrangle(spark: SparkSession, folder: str) -> DataFrame:
    return paired_lines(table(spark, folder, "documents"), "doc_id", "text")


@query("pdf_wrangle", "select n_nationkey, v.header, v.value from nation, lateral (values ('nation', cast(n_nationkey as varchar)), ('name', n_name), ('region', cast(n_regionkey as varchar))) v(header, value)")
def pdf_wrangle(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in pairs read from PDF files, one for each nation, written here."""
    root = scratch(spark, "pdf")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():  # a fixed table of 25 rows
        out = fs.create(path(f"{root}/{row['n_nationkey']}.pdf"), True)
        out.write(bytearray(written(["nation", "name", str(row["n_nationkey"]), row["n_name"], "region", str(row["n_regionkey"])])))
        out.close()
    docs = pdf_files(spark, root).withColumn("n_nationkey", F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("int"))
    return paired_lines(docs, "n_nationkey", "text")


@query("federated_join", """
select o_orderkey, c_name, cast(o_totalprice as decimal(18,2)) as total from orders join customer on cast(o_custkey as varchar) = cast(c_custkey as varchar)
where o_orderdate >= timestamp '1997-01-01' order by o_totalprice desc, o_orderkey limit 50""")
def federated_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two catalogs whose keys have different types, joined on a cast; the fifty largest."""
    orders = table(spark, folder, "orders").filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).withColumn("key", F.col("o_custkey").cast("string"))
    users = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name")
    return orders.join(users, "key").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "c_name", money("o_totalprice").alias("total"))


@query("group_having_distinct", """
select o_custkey, count(*) as orders, count(distinct o_orderpriority) as priorities, bool_or(o_orderstatus = 'F') as any_final, max(o_totalprice) as largest from orders group by 1 having count(*) > 1""")
def group_having_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("o_orderpriority").alias("priorities"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"), F.max("o_totalprice").alias("largest")
    ).filter("orders > 1")


@query("distinct_and_drop_duplicates", """
select o_custkey, o_orderstatus, min(o_orderkey) as first_order from orders group by 1, 2""")
def distinct_and_drop_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per pair of keys, a defined one: the smallest order."""
    return table(spark, folder, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("first_order"))


@query("partial_reaggregation", """
select l_returnflag, count(*) as rows, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total from lineitem group by 1""")
def partial_reaggregation(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"), F.sum(money("l_extendedprice")).alias("total"))
    return parts.groupBy("l_returnflag").agg(F.sum("rows").alias("rows"), F.sum("total").cast("double").alias("total"))


@query("quantiles", """
select round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.75), 4) as q75, round(quantile_cont(l_extendedprice, 0.95), 4) as q95 from lineitem""")
def quantiles(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "lineitem").agg(F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.95))).alias("q"))
    return q.select(F.round(F.col("q")[0], 4).alias("q25"), F.round(F.col("q")[1], 4).alias("q75"), F.round(F.col("q")[2], 4).alias("q95"))


@query("quantiles_approximate", "select p, true as near from (values (0.25), (0.75), (0.95)) v(p)")
def quantiles_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the share of rows up to each approximate quantile is within a thousandth of what it stands for."""
    lines = table(spark, folder, "lineitem").select("l_extendedprice")
    wanted = [0.25, 0.75, 0.95]
    q = lines.agg(F.percentile_approx("l_extendedprice", wanted, 10_000).alias("q"))  # one row
    counted = lines.join(F.broadcast(q)).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("l_extendedprice") <= F.col("q")[i]).alias(f"c{i}") for i in range(3)))
    each = F.array(*(F.struct(F.lit(p).cast("double").alias("p"), (F.abs(F.col(f"c{i}") / F.col("n") - p) <= 0.001).alias("near")) for i, p in enumerate(wanted)))
    return counted.select(F.inline(each))


@query("describe_summary", """
select count(o_totalprice) as n, round(avg(o_totalprice), 3) as mean, round(stddev(o_totalprice), 3) as sd, min(o_totalprice) as low, max(o_totalprice) as high from orders""")
def describe_summary(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, folder, "orders").agg(F.count(x).alias("n"), F.round(F.avg(x), 3).alias("mean"), F.round(F.stddev(x), 3).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))


@query("pivot_event_value", """
select cast(ts as date) as day, round(sum(case when event_type = 'click' then value end), 4) as click, round(sum(case when event_type = 'error' then value end), 4) as error,
  round(sum(case when event_type = 'purchase' then value end), 4) as purchase, round(sum(case when event_type = 'signup' then value end), 4) as signup, round(sum(case when event_type = 'view' then value end), 4) as view
from events group by 1""")
def pivot_event_value(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = table(spark, folder, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    out = m.pivot_sum(rows, "day", "event_type", "value", kinds)
    return out.select("day", *(F.round(k, 4).alias(k) for k in kinds))


@query("union_by_name_missing", """
select event_id, user_id, cast(null as varchar) as event_type from events where event_id % 2 = 0 union all select event_id, cast(null as bigint), event_type from events where event_id % 2 = 1""")
def union_by_name_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Two shapes of one stream of events, told apart by the parity of their ids."""
    events = table(spark, folder, "events")
    one = events.filter("event_id % 2 = 0").select("event_id", "user_id")
    two = events.filter("event_id % 2 = 1").select("event_id", "event_type")
    return one.unionByName(two, allowMissingColumns=True)


@query("set_difference", """
select * from (select o_custkey as k from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'O') order by k""")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    pick = lambda s: orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return pick("F").exceptAll(pick("O")).orderBy("k")


@query("window_family", """
select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as int) as latest, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as before,
  first_value(o_orderkey) over w as first_order, last_value(o_orderkey) over w as last_order
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)""")
def window_family(spark: SparkSession, folder: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, folder, "orders").select(
        "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")).alias("latest"),
        F.lag("o_totalprice").over(by).alias("before"), F.first("o_orderkey").over(whole).alias("first_order"), F.last("o_orderkey").over(whole).alias("last_order"),
    )


@query("global_top10", """
select cast(row_number() over (order by o_totalprice desc, o_orderkey) as int) as rank, o_orderkey from orders order by 1 limit 10""")
def global_top10(spark: SparkSession, folder: str) -> DataFrame:
    return m.top_numbered(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10).select("rank", "o_orderkey")


@query("top_per_group", """
select c_mktsegment, c_custkey, cast(rn as int) as rank from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from customer) where rn <= 3""")
def top_per_group(spark: SparkSession, folder: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    return table(spark, folder, "customer").withColumn("rank", rank).filter("rank <= 3").select("c_mktsegment", "c_custkey", "rank")


@query("multi_grain_rollup", """
select 'day' as grain, cast(ts as date) as period, count(*) as events from events group by 2
union all select 'month', cast(date_trunc('month', ts) as date), count(*) from events group by 2 union all select 'year', cast(date_trunc('year', ts) as date), count(*) from events group by 2""")
def multi_grain_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Days first; months and years add up the days, so the events are read once for all three."""
    days = table(spark, folder, "events").groupBy(F.to_date("ts").alias("period")).agg(F.count(F.lit(1)).alias("events"))
    out = days.withColumn("grain", F.lit("day"))
    for grain in ("month", "year"):
        out = out.unionByName(days.groupBy(F.trunc("period", grain).alias("period")).agg(F.sum("events").alias("events")).withColumn("grain", F.lit(grain)))
    return out


@query("scalar_functions", """
select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(dayofweek(o_orderdate) + 1 as int) as dow, cast(last_day(o_orderdate) as date) as eom,
  strftime(o_orderdate, '%Y/%m/%d') as text, case when month(o_orderdate) < 4 then cast(year(o_orderdate) - 1 as int) else cast(year(o_orderdate) as int) end as fiscal,
  sha256(cast(o_orderkey as varchar)) as token, rpad(o_orderstatus, 3, '_') as padded, regexp_extract(o_orderpriority, '^([0-9])', 1) as level, round(ln(o_totalprice), 6) as ln_total,
  cast(floor(o_totalprice) as bigint) as whole, cast(o_orderdate + interval 1 month as date) as next_month, concat_ws('-', o_orderstatus, substr(o_orderpriority, 1, 1)) as joined
from orders""")
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    c = m.calendar(d)
    return table(spark, folder, "orders").select(
        "o_orderkey", c["year"].alias("y"), c["month"].alias("m"), c["weekday"].alias("dow"), F.last_day(d).alias("eom"), F.date_format(d, "yyyy/MM/dd").alias("text"), c["fiscal_year"].alias("fiscal"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token"), F.rpad("o_orderstatus", 3, "_").alias("padded"), F.regexp_extract("o_orderpriority", "^([0-9])", 1).alias("level"),
        F.round(F.log("o_totalprice"), 6).alias("ln_total"), F.floor("o_totalprice").cast("bigint").alias("whole"), F.add_months(d, 1).alias("next_month"),
        F.concat_ws("-", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("joined"),
    )


@query("aes_round_trip", "select c_custkey, c_name as name from customer")
def aes_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Cipher text differs from run to run, so the check is what decryption gives back."""
    from ..operators.privacy import decrypt, encrypt

    key = "000102030405060708090a0b0c0d0e0f"  # a test key
    hidden = table(spark, folder, "customer").select("c_custkey", encrypt(F.col("c_name"), key).alias("c"))
    return hidden.select("c_custkey", decrypt(F.col("c"), key).alias("name"))


@query("cached_scan", "select event_type, count(*) as n from events group by 1 union all select 'all', count(*) from events")
def cached_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One cached relation read by two aggregates."""
    events = table(spark, folder, "events").select("event_type").cache()
    by = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(events.agg(F.count(F.lit(1)).alias("n")).withColumn("event_type", F.lit("all")))
