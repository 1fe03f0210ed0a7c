"""Queries over the fund masters: history of attributes, drifting files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_width, folded
from ..operators.drift_schema import canonical, schema_changes, united, valid_records
from ..operators.history import versions
from ..sources import table
from . import Registry

REGISTRY = query = Registry()

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _UPPER + _UPPER.lower()) + "　"
_CATEGORY = f"lower(trim(translate(fund_category, '{_WIDE}', '{_UPPER}{_UPPER.lower()} ')))"
VERSIONS_SQL = f"""
with latest as (
  select fund_id, ingest_date as day, fund_category, trust_fee_rate, is_active from (
    select *, row_number() over (partition by fund_id, ingest_date order by load_seq desc) as rn from fund_master_v2) where rn = 1),
base as (select distinct fund_id, fund_category, trust_fee_rate, is_active, effective_start_date, effective_end_date, is_current from dim_fund),
line as (
  select fund_id, day, fund_category, trust_fee_rate, is_active, 1 as snap from latest
  union all select fund_id, effective_start_date, fund_category, trust_fee_rate, is_active, 0 from base where is_current),
printed as (select *, coalesce({_CATEGORY}, '~') || '|' || coalesce(trust_fee_rate::varchar, '~') || '|' || coalesce(is_active::varchar, '~') as print from line),
lagged as (select *, lag(print) over (partition by fund_id order by snap, day) as prior from printed),
starts as (select * from lagged where prior is distinct from print),
live as (select *, lead(day) over (partition by fund_id order by snap, day) as until from starts)
"""


def fund_versions(spark: SparkSession, folder: str) -> DataFrame:
    attributes = {"fund_category": folded(F.col("fund_category")), "trust_fee_rate": F.col("trust_fee_rate"), "is_active": F.col("is_active")}
    return versions(
        table(spark, folder, "fund_master_v2").select("load_seq", "fund_id", "fund_category", "trust_fee_rate", "is_active", "ingest_date"),
        table(spark, folder, "dim_fund"),
        "fund_id", "ingest_date", "load_seq", attributes, "effective_start_date", "effective_end_date", "is_current",
    )


@query("p4_found", VERSIONS_SQL + f"""
select distinct fund_id, strftime(day, '%Y-%m-%d') as effective_start_date from (
  select fund_id, day from live union all select fund_id, effective_start_date from base where not is_current)""")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return fund_versions(spark, folder).select("fund_id", F.date_format("effective_start_date", "yyyy-MM-dd").alias("effective_start_date")).distinct()


@query("p4_versions", VERSIONS_SQL + f"""
select fund_id, {_CATEGORY} as fund_category, trust_fee_rate, is_active, day as effective_start_date, coalesce(until, date '9999-12-31') as effective_end_date, until is null as is_current from live
union all select fund_id, {_CATEGORY}, trust_fee_rate, is_active, effective_start_date, effective_end_date, false from base where not is_current""")
def p4_versions(spark: SparkSession, folder: str) -> DataFrame:
    return fund_versions(spark, folder).withColumn("fund_category", folded(F.col("fund_category")))


def alias_rules(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """The alias table, a hand-kept list of rules, as (pattern, canonical name, priority)."""
    rows = table(spark, folder, "column_alias_map").filter("regex is not null and canonical_name is not null").collect()
    return [(r["regex"], r["canonical_name"], r["priority"] if r["priority"] is not None else 99) for r in rows]


def drift(spark: SparkSession, folder: str) -> DataFrame:
    return schema_changes(table(spark, folder, "fund_files"), table(spark, folder, "fund_file_lines"), alias_rules(spark, folder))


@query("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift(spark, folder).filter("kind <> 'column'").select("file_id", F.col("kind").alias("change_kind"), F.col("name").alias("column_name"))


@query("p1_records", """
select l.file_id, count(*) as records from fund_file_lines l where json_valid(l.line) and json_type(l.line) = 'OBJECT' and l.file_id is not null group by 1""")
def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """How many records each file has: the lines that count, for the changes and for the table alike."""
    return valid_records(table(spark, folder, "fund_file_lines")).groupBy("file_id").agg(F.count(F.lit(1)).alias("records"))


#: The columns of the one fund table.
FIELDS = {
    "fund_id": "string", "fund_category": "string", "trust_fee_rate": "decimal(6,3)", "is_active": "boolean", "fund_name": "string",
    "nickname": "string", "management_company": "string", "hidden_cost": "decimal(6,3)", "inception_date": "date",
}


@query("p1_unified")
def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Both masters and all files as one table; each column found by name rules and the matching of files."""
    rules = alias_rules(spark, folder)
    whole = united(table(spark, folder, "fund_files"), table(spark, folder, "fund_file_lines"), drift(spark, folder), FIELDS)
    for name in ("fund_master_v2", "legacy_fund_master"):
        master = table(spark, folder, name)
        targets = {canonical(c, rules)[0]: c for c in reversed(master.columns) if c != "ingest_date"}
        typed = [(F.col(f"`{targets[f]}`") if f in targets else F.lit(None)).cast(kind).alias(f) for f, kind in FIELDS.items()]
        rest = [c for c in master.columns if c not in targets.values() and c not in ("ingest_date", "load_seq")]
        extras = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest))) if rest else F.lit(None).cast("string")
        whole = whole.unionByName(master.select(F.lit(name).alias("source"), F.lit(None).cast("bigint").alias("file_id"), F.col("ingest_date").alias("as_of"), *typed, extras.alias("extras")))
    category = F.upper(F.trim(fold_width(F.col("fund_category"))))
    return whole.withColumn("fund_category", category).distinct()  # repeated rows of files and masters alike
