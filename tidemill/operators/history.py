"""Validity periods of changing attributes from periodic snapshots (gaps and islands).

Defined results: of several rows for one entity and date the greatest sequence number holds; null is a value like any
other; an entity missing from a snapshot has not changed; rows without entity or date say nothing and are left out;
exact repeats change nothing; an empty table has no versions; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"

def fingerprint(columns: list[Column]) -> Column:
    """A null-safe value that is equal exactly when all columns are."""
    return F.to_json(F.struct(*(c.cast("string").alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "true"})


def latest_per_day(rows: DataFrame, key: str, day: str, sequence: str, values: list[str]) -> DataFrame:
    """One row per key and day, that of the greatest sequence.  A pre-aggregation: a key then has one row per day at most,
    however often it was loaded."""
    best = F.max(F.struct(F.col(sequence).alias("_seq"), *values)).alias("_best")
    return rows.filter(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(key, day).agg(best).select(key, day, "_best.*").drop("_seq")


def versions(snapshots: DataFrame, base: DataFrame, key: str, day: str, sequence: str, attributes: dict[str, Column], start: str, end: str, current: str) -> DataFrame:
    """Every version of every entity: those ``base`` holds, then one per snapshot date on which an attribute differs.

    ``attributes`` maps a column to the expression it is compared by.  Columns out: key, the attributes as written at the
    version's first date, ``effective_start_date``, ``effective_end_date`` (exclusive), ``is_current``.
    """
    names = list(attributes)
    days = latest_per_day(snapshots, key, day, sequence, names).select(key, F.col(day).alias("_day"), *names, F.lit(False).alias("_base"))
    old = base.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
        key, F.col(start).alias("_day"), *names, F.lit(True).alias("_base"), F.col(current).alias("_now"), F.col(end).alias("_until")
    ).distinct()
    closed = old.filter("not coalesce(_now, false)")
    line = days.unionByName(old.filter("_now").drop("_now", "_until"))
    marked = line.withColumn("_print", fingerprint(list(attributes.values())))
    order = Window.partitionBy(key).orderBy(F.col("_base").desc(), "_day")
    changed = F.when(F.lag("_print").over(order) == F.col("_print"), 0).otherwise(1)
    islands = marked.withColumn("_changed", changed).withColumn("_island", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = islands.groupBy(key, "_island").agg(
        F.min_by(F.struct("_day", *names), F.struct(~F.col("_base"), F.col("_day"))).alias("_first")
    ).select(key, "_island", "_first.*")
    following = F.lead("_day").over(Window.partitionBy(key).orderBy("_island"))
    live = rows.withColumn("_until", following).select(
        key, *names, F.col("_day").alias("effective_start_date"), F.coalesce("_until", F.lit(OPEN_END).cast("date")).alias("effective_end_date"), F.col("_until").isNull().alias("is_current")
    )
    past = closed.select(key, *names, F.col("_day").alias("effective_start_date"), F.col("_until").alias("effective_end_date"), F.lit(False).alias("is_current"))
    return past.unionByName(live)
