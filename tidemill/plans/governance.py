"""Queries for contracts, quality, privacy, matching and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SINGLE, VOICED, fold_width
from ..operators import contract as c
from ..operators import privacy as p
from ..operators import quality as q
from ..operators.lineage import plan_text, require_partition_filter
from ..operators.matching import deterministic_match, mapped, minhash_match, regex_tokens, similarity_match
from ..session import scratch
from ..sources import generator, table
from . import Registry
from .relational import money

REGISTRY = query = Registry()

#: A contract for parts; comments and the trailing comma are part of the format.
CONTRACT = c.load("""{
  "type": "record", "name": "part", // see https://contracts.example/part
  "fields": [
    {"name": "p_partkey", "type": "long"},
    {"name": "p_name", "type": ["null", "string"], "rules": {"min_length": 9}},
    {"name": "p_brand", "type": "string", "rules": {"pattern": "^Brand#[1-4][0-9]$"}},
    {"name": "p_size", "type": "int", "rules": {"min": 1, "max": 45}},
    {"name": "p_retailprice", "type": {"type": "bytes", "logicalType": "decimal", "precision": 18, "scale": 2}},
    {"name": "status", "type": "string", "default": "new"},
  ],
  "row_rules": [{"name": "cheap_if_small", "expr": "p_size >= 5 or p_retailprice < 990"}]
}""")

_CAST = "(select p_partkey, p_name, p_brand, p_size, cast(p_retailprice as decimal(18,2)) as p_retailprice, 'new' as status, p_type from part)"
_BROKEN = """(select *, list_filter([case when not coalesce(length(p_name) >= 9, false) then 'p_name_min_length' end, case when p_brand is not null and not regexp_matches(p_brand, '^Brand#[1-4][0-9]$') then 'p_brand_pattern' end,
  case when p_size < 1 or p_size > 45 then 'p_size_range' end, case when not coalesce(p_size >= 5 or p_retailprice < 990, false) then 'cheap_if_small' end], lambda x: x is not null) as v from %s)""" % _CAST


def validated(spark: SparkSession, folder: str) -> DataFrame:
    return c.contract_validate(c.contract_cast(table(spark, folder, "part"), CONTRACT), CONTRACT)


@query("contract_cast_extras", f"select p_partkey, p_name, p_size, p_retailprice, status, 'p_type=' || p_type as extras from {_CAST}")
def contract_cast_extras(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.contract_cast(table(spark, folder, "part"), CONTRACT)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("_extras"), lambda e: F.concat(e.key, F.lit("="), e.value))), ",")
    return rows.select("p_partkey", "p_name", "p_size", "p_retailprice", "status", text.alias("extras"))


@query("contract_validate", f"select p_partkey, array_to_string(v, ',') as violations from {_BROKEN} where len(v) > 0")
def contract_validate(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = c.split(validated(spark, folder))
    return bad.select("p_partkey", F.array_join("_violations", ",").alias("violations"))


@query("contract_violation_counts", f"select rule, count(*) as rows from (select unnest(v) as rule from {_BROKEN}) group by 1")
def contract_violation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return c.violation_counts(validated(spark, folder))


@query("schema_drift_report", """
with have as (select column_name as name, column_type as type from (describe part)), want(name, type) as (values ('p_partkey', 'BIGINT'), ('p_name', 'VARCHAR'), ('p_brand', 'VARCHAR'), ('p_size', 'INTEGER'), ('p_retailprice', 'DECIMAL(18,2)'), ('status', 'VARCHAR'))
select 'unexpected' as kind, name as column from have where name not in (select name from want) union all select 'missing', name from want where name not in (select name from have)
union all select 'mismatched', h.name from have h join want w on h.name = w.name where h.type <> w.type""")
def schema_drift_report(spark: SparkSession, folder: str) -> DataFrame:
    """How the table differs from its contract before any cast."""
    found = c.schema_drift(table(spark, folder, "part"), CONTRACT)
    return spark.createDataFrame([(kind, x if isinstance(x, str) else x[0]) for kind, names in found.items() for x in names], "kind string, column string")


@query("contract_gates", f"""
with t as (select count(*) as total, count(*) filter (len(v) > 0) as bad from {_BROKEN}), d as (select count(*) as dup from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))
select 'drift' as run, 2 as code union all select 'drift allowed', 0 union all select 'duplicates', case when dup > 0 then 4 else 0 end from d
union all select 'bad rows', case when bad > 10 then 3 else 0 end from t union all select 'bad rate', case when bad / total > 0.99 then 3 else 0 end from t""")
def contract_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Exit codes of runs with different limits."""
    drift = c.schema_drift(table(spark, folder, "part"), CONTRACT)
    total, bad = validated(spark, folder).agg(F.count(F.lit(1)), F.count_if(F.size("_violations") > 0)).first()
    duplicates = c.pk_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]).count()
    codes = [
        ("drift", c.gate(drift)), ("drift allowed", c.gate(drift, allow_drift=True)), ("duplicates", c.gate(duplicates=duplicates)),
        ("bad rows", c.gate(bad=bad, total=total, max_bad=10)), ("bad rate", c.gate(bad=bad, total=total, max_rate=0.99)),
    ]
    return spark.createDataFrame(codes, "run string, code int")


@query("producer_validation", """
with t as (select case when not coalesce(regexp_matches(ID, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$'), false) then 'identifier' when not coalesce(quantity > 0, false) then 'quantity' else 'sent' end as verdict from orders_microbatch_window_raw)
select verdict, count(*) as rows from t group by 1""")
def producer_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How many messages a producer would send, and why it refuses the others."""
    good, bad = generator.validated(table(spark, folder, "orders_microbatch_window_raw").select("ID", "quantity"), "ID", "quantity")
    return good.select(F.lit("sent").alias("verdict")).unionByName(bad.select(F.col("reason").alias("verdict"))).groupBy("verdict").agg(F.count(F.lit(1)).alias("rows"))


@query("partition_guard", "select 'with the day' as query, true as allowed union all select 'without it', false")
def partition_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a query on a partitioned table passes the rule that it must filter on the partition column."""
    path = scratch(spark, "guarded")
    table(spark, folder, "nation").withColumn("day", F.col("n_regionkey")).write.partitionBy("day").parquet(path)
    rows, out = spark.read.parquet(path), []
    for name, df in (("with the day", rows.filter("day = 1")), ("without it", rows.filter("n_nationkey = 1"))):
        try:
            require_partition_filter(df, "day")
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "query string, allowed boolean")


@query("plan_cached_or_not", "select 'plain' as plan, false as from_memory union all select 'cached', true")
def plan_cached_or_not(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the plan of the same query reads the table or its cached form."""
    rows = table(spark, folder, "nation").filter("n_regionkey = 1")
    plain = "InMemoryTableScan" in plan_text(rows.groupBy("n_regionkey").count())
    rows.cache()
    cached = "InMemoryTableScan" in plan_text(rows.groupBy("n_regionkey").count())
    rows.unpersist()
    return spark.createDataFrame([("plain", plain), ("cached", cached)], "plan string, from_memory boolean")


@query("pk_duplicates", "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1")
def pk_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return c.pk_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("slo_latency", """
with l as (select epoch(date_trunc('second', ingest_ts)) - epoch(date_trunc('second', coalesce(created_at, processing_time))) as lag from orders_microbatch_window_raw)
select count(lag) as rows, round(avg(case when lag <= 600 then 1.0 else 0.0 end), 6) as ok_ratio, round(quantile_cont(lag, 0.95), 3) as p95_s from l""")
def slo_latency(spark: SparkSession, folder: str) -> DataFrame:
    out = c.slo_latency(table(spark, folder, "orders_microbatch_window_raw"), "created_at", "processing_time", "ingest_ts", 600, exact=True)
    return out.select("rows", F.round("ok_ratio", 6).alias("ok_ratio"), F.round("p95_s", 3).alias("p95_s"))


_DQ = """select '{rule}' as rule, '{column}' as column, {rows} as rows, {bad} as violations, round(1 - {bad} / {rows}, 4) as pass_rate, case when round(1 - {bad} / {rows}, 4) >= {need} then 'PASS' else 'FAIL' end as status from {source}"""
_RAW, _COUNT = "orders_microbatch_window_raw", "count(*)"
_DQ_ROWS = [
    ("is_complete", "user_id", "count(*) filter (user_id is null)", 1.0),
    ("is_complete", "total_usd", "count(*) filter (total_usd is null)", 1.0),
    ("is_between", "created_at", "count(*) filter (not coalesce(created_at between timestamp '2000-01-01' and timestamp '2100-01-01', false))", 0.99),
    ("sum_identity", "total_usd", "count(*) filter (not coalesce(abs(subtotal_usd + tax_usd - total_usd) < 0.005, false) or isnan(subtotal_usd + tax_usd))", 0.9),
    ("leading_zero", "ID", "count(*) filter (not coalesce(not regexp_matches(ID, '^0[0-9]+$'), false))", 0.9),
]


@query("dq_report", " union all ".join(_DQ.format(rule=r, column=col, rows=_COUNT, bad=bad, need=need, source=_RAW) for r, col, bad, need in _DQ_ROWS) + """
union all select 'is_unique', 'delivery_no', count(delivery_no), count(delivery_no) - count(distinct delivery_no), 1.0, 'PASS' from orders_microbatch_window_raw
union all select 'has_parent', 'user_id', count(*), count(*) filter (h is null), round(1 - count(*) filter (h is null) / count(*), 4), case when round(1 - count(*) filter (h is null) / count(*), 4) >= 0.9 then 'PASS' else 'FAIL' end
  from orders_microbatch_window_raw o left join (select distinct try_cast(user_id as int) as u, 1 as h from users) p on o.user_id = p.u""")
def dq_report(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "orders_microbatch_window_raw")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    sums = F.col("subtotal_usd") + F.col("tax_usd") - F.col("total_usd")
    report = q.run_rules(raw, [
        q.complete("user_id"), q.complete("total_usd"), q.Rule("is_between", "created_at", (F.col("created_at") >= day("2000-01-01")) & (F.col("created_at") <= day("2100-01-01")), 0.99),
        q.Rule("sum_identity", "total_usd", (F.abs(sums) < 0.005) & ~F.isnan(sums), 0.9), q.Rule("leading_zero", "ID", ~q.leading_zero("ID"), 0.9),
    ])
    users = table(spark, folder, "users").select(F.expr("try_cast(user_id as int)").alias("user_id"))
    return report.unionByName(q.unique(raw, "delivery_no")).unionByName(q.references(raw, "user_id", users, "user_id", 0.9))


@query("iqr_outliers", """
with b as (select quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3 from customer) select c_custkey, c_acctbal from customer, b where c_acctbal < q1 - 0.3 * (q3 - q1) or c_acctbal > q3 + 0.3 * (q3 - q1)""")
def iqr_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return q.outliers(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.3, exact=True)


@query("fk_check", "select count(*) as rows, count(*) filter (user_id is null or user_id not in (select cast(user_id as int) from users)) as violations from orders_microbatch_window_raw")
def fk_check(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "users").select(F.expr("try_cast(user_id as int)").alias("user_id"))
    return q.references(table(spark, folder, "orders_microbatch_window_raw"), "user_id", users, "user_id").select("rows", "violations")


# privacy

_CELLS = """(select cast(date_trunc('month', o_orderdate) as date) as month, cast(c_nationkey as varchar) as nation, c_mktsegment as segment, count(*) as rows, count(distinct c_custkey) as users,
  sum(cast(o_totalprice as decimal(18,2))) as sales, count(*) as quantity from orders join customer on o_custkey = c_custkey group by 1, 2, 3)"""
QUASI, K = ["month", "nation", "segment"], 3


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", money("o_totalprice").alias("amount"))
    rows = orders.join(table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    return rows.select("c_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"), "amount", F.lit(1).cast("bigint").alias("quantity"))


@query("k_anonymity_cells", f"select month, nation, segment, rows, users, cast(sales as double) as sales, quantity from {_CELLS}")
def k_anonymity_cells(spark: SparkSession, folder: str) -> DataFrame:
    return p.cells(purchases(spark, folder), QUASI, "c_custkey", "amount", "quantity").drop("average").withColumn("sales", F.col("sales").cast("double"))


@query("k_anonymity_other_merge", f"""
select month, case when users < {K} then 'Other' else nation end as nation, case when users < {K} then 'Other' else segment end as segment, cast(sum(rows) as bigint) as rows, cast(sum(users) as bigint) as users, cast(sum(sales) as double) as sales, cast(sum(quantity) as bigint) as quantity, sum(users) < {K} as is_small from {_CELLS} group by 1, 2, 3""")
def k_anonymity_other_merge(spark: SparkSession, folder: str) -> DataFrame:
    return p.k_anonymize(purchases(spark, folder), QUASI, "c_custkey", "amount", "quantity", K, ["nation", "segment"], exact_distinct=False).drop("average").withColumn("sales", F.col("sales").cast("double"))


_RELABELLED = f"""(select date_trunc('month', o_orderdate) as m, c_custkey, case when users < {K} then 'Other' else nation end as nation, case when users < {K} then 'Other' else segment end as segment
  from orders join customer on o_custkey = c_custkey join {_CELLS} c on cast(date_trunc('month', o_orderdate) as date) = c.month and cast(c_nationkey as varchar) = c.nation and c_mktsegment = c.segment)"""


@query("k_anonymity_exact", f"select cast(m as date) as month, nation, segment, count(*) as rows, count(distinct c_custkey) as users, count(distinct c_custkey) < {K} as is_small from {_RELABELLED} group by 1, 2, 3")
def k_anonymity_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Merged cells with their users counted anew, so that no user counts twice."""
    return p.k_anonymize(purchases(spark, folder), QUASI, "c_custkey", "amount", "quantity", K, ["nation", "segment"]).select(*QUASI, "rows", "users", "is_small")


@query("k_anonymity_dummies", f"select cast(m as date) as month, nation, segment, greatest(count(distinct c_custkey), {K}) as users, false as is_small from {_RELABELLED} group by 1, 2, 3")
def k_anonymity_dummies(spark: SparkSession, folder: str) -> DataFrame:
    """Merged cells that are still too small are filled up with dummy users."""
    return p.k_anonymize(purchases(spark, folder), QUASI, "c_custkey", "amount", "quantity", K, ["nation", "segment"], dummies=True).select(*QUASI, "users", "is_small")


@query("k_anonymity_violations", f"select month, nation, segment, users from {_CELLS} where users < {K}")
def k_anonymity_violations(spark: SparkSession, folder: str) -> DataFrame:
    return p.k_violations(purchases(spark, folder), QUASI, "c_custkey", K)


@query("pseudonymize_tokens", "select substr(sha256('pepper' || user_id), 1, 16) as user_token, acquisition_channel, case when birth_date is not null then cast(date_diff('year', birth_date, date '2025-01-01') - case when strftime(birth_date, '%m%d') > '0101' then 1 else 0 end as int) // 5 * 5 end as band_low from users")
def pseudonymize_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "users").withColumn("band_low", F.split(p.age_band(F.col("birth_date"), "2025-01-01"), "-")[0].cast("int"))
    return p.pseudonymize(rows.select("user_id", "user_name", "acquisition_channel", "band_low"), {"user_id": "user_token"}, "pepper", ["user_name"])


@query("address_regions", "select user_id, regexp_extract(address, '^([^0-9 　]{2}[都府県])', 1) as prefecture from users where address is not null")
def address_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The prefecture an address begins with, the empty text without one."""
    pref = F.regexp_extract("address", r"^([^0-9 　]{2}[都府県])", 1)
    return table(spark, folder, "users").filter("address is not null").select("user_id", pref.alias("prefecture"))


_PREFECTURES = "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"


@query("regions_of_customers", f"""
with p as (select c_custkey, c_custkey % 47 as k, split('{_PREFECTURES}', ' ')[cast(c_custkey % 47 as int) + 1] as prefecture from customer)
select c_custkey, prefecture, case when k = 0 then '北海道' when k <= 6 then '東北' when k <= 13 then '関東' when k <= 22 then '中部' when k <= 29 then '近畿' when k <= 34 then '中国' when k <= 38 then '四国' else '九州・沖縄' end as region from p""")
def regions_of_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Every prefecture's region, read from an address that begins with it."""
    name = F.element_at(F.split(F.lit(_PREFECTURES), " "), (F.col("c_custkey") % 47 + 1).cast("int"))
    rows = table(spark, folder, "customer").select("c_custkey", F.concat(name, F.lit("中央市本町1-2-3")).alias("address"))
    rows = rows.withColumn("prefecture", p.prefecture(F.col("address")))
    return rows.select("c_custkey", "prefecture", p.region(F.col("prefecture")).alias("region"))


PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"


@query("pattern_scan_counts", " union all ".join(f"select '{col}' as column, count(*) filter (regexp_matches({col}, '{PATTERN}')) as hits from users" for col in ("user_id", "address", "email", "password", "user_name", "acquisition_channel", "zip_code")))
def pattern_scan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p.pattern_counts(table(spark, folder, "users"), PATTERN)


@query("pattern_scan_flags", "select doc_id, regexp_matches(text, 'https?://') as text_hit, false as lang_hit, false as source_hit from documents where regexp_matches(text, 'https?://')")
def pattern_scan_flags(spark: SparkSession, folder: str) -> DataFrame:
    return p.pattern_flags(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), "https?://").drop("text", "lang", "source")


@query("secure_view_analyst", "select c_custkey, repeat('*', cast(length(c_name) as bigint)) as c_name, c_mktsegment from customer where c_custkey < 10 or c_custkey > 100")
def secure_view_analyst(spark: SparkSession, folder: str) -> DataFrame:
    policy = p.Policy(
        [("admin", "", "allow"), ("analyst", "silver.customer", "allow"), ("analyst", "silver.", "deny"), ("analyst", "bronze.", "deny"), ("*", "", "allow")],
        {("analyst", "silver.customer"): lambda: (F.col("c_custkey") < 10) | (F.col("c_custkey") > 100)},
        {("analyst", "silver.customer"): {"c_name": p.masked}},
    )
    return policy.view(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), "analyst", "silver.customer")


# matching

def _folded(column: str) -> str:
    """SQL of the text in one width and lower case."""
    quoted = [t.replace("'", "''") for t in ("".join(SINGLE), "".join(SINGLE.values()))]
    out = f"translate({column}, '{quoted[0]}', '{quoted[1]}')"
    for pair, whole in VOICED.items():
        out = f"replace({out}, '{pair}', '{whole}')"
    return f"lower({out})"


_NAMES = f"""a as (select fund_id, {_folded('fund_name')} as t from fund_master_v2 where fund_name is not null),
b as (select fund_id, {_folded('"ファンド名"')} as t from legacy_fund_master where "ファンド名" is not null)"""
_MATCHED = f"""with {_NAMES}, m as (select distinct a.fund_id as id_a, b.fund_id as id_b from a join b on regexp_replace(a.t, '\\s+', '', 'g') = regexp_replace(b.t, '\\s+', '', 'g'))"""


@query("deterministic_match", f"{_MATCHED} select id_a, id_b from m")
def deterministic_match_query(spark: SparkSession, folder: str) -> DataFrame:
    """Funds of both masters whose names are equal but for width, case and blanks, in any script."""
    new = table(spark, folder, "fund_master_v2").select("fund_id", "fund_name")
    old = table(spark, folder, "legacy_fund_master").select("fund_id", F.col("ファンド名").alias("fund_name"))
    return deterministic_match(new, old, ["fund_name"], "fund_id", "fund_id")


@query("deterministic_mapping", f"""{_MATCHED} select l.fund_id, "ファンド名" as fund_name, id_a as new_fund_id from legacy_fund_master l left join m on l.fund_id = m.id_b""")
def deterministic_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The old master with the new id of each fund, null where no name is equal."""
    new = table(spark, folder, "fund_master_v2").select("fund_id", "fund_name")
    old = table(spark, folder, "legacy_fund_master").select("fund_id", F.col("ファンド名").alias("fund_name"))
    return mapped(old, deterministic_match(new, old, ["fund_name"], "fund_id", "fund_id"), "fund_id", "id_b", "id_a", "new_fund_id")


def _companies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    new = table(spark, folder, "fund_master_v2").select("fund_id", F.lower(fold_width(F.col("fund_name"))).alias("name"))
    return new, table(spark, folder, "legacy_fund_master").select("fund_id", F.lower(fold_width(F.col("ファンド名"))).alias("name"))


_SETS = """select list_sort(list_distinct(regexp_extract_all(t, '[\\p{{Han}}]+|[\\p{{Hiragana}}]+|[ァ-ヺ]+|[a-z0-9]+'))) as s, min(t) as text, count(distinct fund_id) as ids from {0} group by 1 having len(s) > 0"""


@query("jaccard_match_exact", f"""
with {_NAMES}, sa as ({_SETS.format('a')}), sb as ({_SETS.format('b')}),
pairs as (select sa.text as text_a, sb.text as text_b, sa.ids as ids_a, sb.ids as ids_b, len(list_intersect(sa.s, sb.s)) as common, len(sa.s) + len(sb.s) as whole from sa, sb)
select text_a, text_b, ids_a, ids_b, 1 - common / (whole - common) as distance from pairs where common > 0 and 1 - common / (whole - common) <= 0.4 + 1e-12""")
def jaccard_match_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Representatives of equal token sets at a Jaccard distance of at most 0.4, with the number of funds on each side."""
    new, old = _companies(spark, folder)
    return similarity_match(new, old, "name", "fund_id", "fund_id", 0.4)


@query("name_tokens", f"""
with {_NAMES} select fund_id, array_to_string(regexp_extract_all(coalesce(t, ''), '[\\p{{Han}}ぁ-んァ-ヺ]+|[a-z0-9]+'), ' ') as words from (select fund_id, {_folded('"ファンド名"')} as t from legacy_fund_master)""")
def name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of fund names by a pattern."""
    old = table(spark, folder, "legacy_fund_master").select("fund_id", F.col("ファンド名").alias("name"))
    return regex_tokens(old, "name", "words").select("fund_id", F.array_join("words", " ").alias("words"))


@query("minhash_match")
def minhash_match_query(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _companies(spark, folder)
    return minhash_match(new, old, "name", "fund_id", "fund_id", 0.4)
