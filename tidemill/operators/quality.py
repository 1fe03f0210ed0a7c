"""A suite of data-quality rules evaluated in one aggregate per table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``ok`` is true where a row passes; null counts as a violation.  ``need`` is the least pass rate."""

    name: str
    column: str
    ok: Column
    need: float = 1.0


def complete(column: str, need: float = 1.0) -> Rule:
    return Rule("is_complete", column, F.col(column).isNotNull(), need)


def between(column: str, low, high, need: float = 1.0) -> Rule:
    return Rule("is_between", column, (F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)), need)


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Report: rule, column, rows, violations, pass_rate (4 decimals), status; all rules in a single pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(~F.coalesce(r.ok, F.lit(False))).alias(f"v{i}") for i, r in enumerate(rules)))
    entries = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.col(f"v{i}").alias("violations"), F.lit(r.need).alias("need")) for i, r in enumerate(rules)))
    rate = F.when(F.col("n") == 0, 1.0).otherwise(F.round(1 - F.col("violations") / F.col("n"), 4))
    return counts.select("n", F.inline(entries)).select(
        "rule", "column", F.col("n").alias("rows"), "violations", rate.alias("pass_rate"), F.when(rate >= F.col("need"), "PASS").otherwise("FAIL").alias("status")
    )


def unique(df: DataFrame, column: str) -> DataFrame:
    """Report row of a uniqueness rule: violations are the rows beyond the first of each value (nulls aside)."""
    groups = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    total = groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("violations"))
    rate = F.when(F.col("rows") == 0, 1.0).otherwise(F.round(1 - F.col("violations") / F.col("rows"), 4))
    return total.select(F.lit("is_unique").alias("rule"), F.lit(column).alias("column"), "rows", "violations", rate.alias("pass_rate"), F.when(rate >= 1.0, "PASS").otherwise("FAIL").alias("status"))


def references(df: DataFrame, column: str, parent: DataFrame, parent_column: str, need: float = 1.0) -> DataFrame:
    """Report row of a reference rule: values without a parent, nulls included, are violations."""
    keys = parent.select(F.col(parent_column).alias(column)).filter(F.col(column).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    counts = df.select(column).join(keys, column, "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_hit").isNull()).alias("violations"))
    rate = F.when(F.col("rows") == 0, 1.0).otherwise(F.round(1 - F.col("violations") / F.col("rows"), 4))
    return counts.select(F.lit("has_parent").alias("rule"), F.lit(column).alias("column"), "rows", "violations", rate.alias("pass_rate"), F.when(rate >= need, "PASS").otherwise("FAIL").alias("status"))


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5, exact: bool = False) -> DataFrame:
    """One row: quartiles and the bounds beyond which values are outliers; approximate quartiles by default."""
    quartiles = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))) if exact else F.percentile_approx(column, [0.25, 0.75], 200)
    q = df.agg(quartiles.alias("q")).select(F.col("q")[0].cast("double").alias("q1"), F.col("q")[1].cast("double").alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - factor * spread).alias("low"), (F.col("q3") + factor * spread).alias("high"))


def outliers(df: DataFrame, column: str, factor: float = 1.5, exact: bool = False) -> DataFrame:
    bounds = iqr_bounds(df, column, factor, exact)  # one row
    return df.join(F.broadcast(bounds), (F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).select(*df.columns)


def text_damage(column: str) -> Column:
    """Replacement characters, mis-decoded sequences or half-width katakana."""
    return F.col(column).rlike("[�｡-ﾟ]|Ã.|â€|縺|繧|繝")


def leading_zero(column: str) -> Column:
    return F.col(column).cast("string").rlike("^0[0-9]+$")
