"""Wide tables, star schemas, slowly changing dimensions, calendars and incremental facts."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def prefixed(df: DataFrame, prefix: str, clashing: set[str]) -> DataFrame:
    """Columns whose names clash with another table's get a prefix."""
    return df.select(*(F.col(c).alias(f"{prefix}_{c}" if c in clashing else c) for c in df.columns))


def wide(fact: DataFrame, dims: list[tuple[DataFrame, list[tuple[str, str]]]]) -> DataFrame:
    """Left joins of a fact with dimensions on (fact column, dimension column) pairs; unmatched facts stay.

    Join sides are left to the optimizer: it broadcasts a dimension whose size it knows to be small.
    """
    out = fact
    for dim, on in dims:
        out = out.join(dim, reduce(Column.__and__, (out[a] == dim[b] for a, b in on)), "left").drop(*(dim[b] for a, b in on if a == b))
    return out


def surrogate(*parts: Column) -> Column:
    """A 64-bit key of the parts' text."""
    return F.xxhash64(F.concat_ws("_", *(p.cast("string") for p in parts)))


def calendar(day: Column, fiscal_start: int = 4) -> dict[str, Column]:
    """Attributes of a date; the week starts on Sunday = 1, a fiscal year bears the year it starts in."""
    return {
        "date_key": F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day),
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "quarter": F.quarter(day),
        "weekday": F.dayofweek(day),
        "year_month": F.year(day) * 100 + F.month(day),
        "fiscal_year": F.when(F.month(day) < fiscal_start, F.year(day) - 1).otherwise(F.year(day)),
        "is_month_end": day == F.last_day(day),
    }


def dim_date(dates: DataFrame, column: str, fiscal_start: int = 4) -> DataFrame:
    days = dates.select(F.to_date(column).alias("date")).filter("date is not null").distinct()
    return days.select("date", *(c.alias(n) for n, c in calendar(F.col("date"), fiscal_start).items()))


def calendar_fill(dates: DataFrame, column: str, known: DataFrame, known_column: str, fiscal_start: int = 4) -> DataFrame:
    """Calendar rows of the dates that ``known`` lacks."""
    fresh = dates.select(F.to_date(column).alias("date")).filter("date is not null").distinct()
    missing = fresh.join(known.select(F.col(known_column).cast("date").alias("date")).distinct(), "date", "left_anti")
    return missing.select("date", *(c.alias(n) for n, c in calendar(F.col("date"), fiscal_start).items()))


def scd2_apply(
    current: DataFrame, source: DataFrame, key: str, tracked: list[str], as_of: str, null_safe: bool = False, close_missing: bool = False
) -> DataFrame:
    """The dimension after one load: changed rows are closed at ``as_of`` and opened again, new ones are opened.

    Intervals are half open.  By default a change to or from null is no change and a missing key stays open; both have a
    flag.  A source with several rows for a key is reduced to its greatest row.
    """
    day = F.lit(as_of).cast("date")
    columns = [key, *tracked]
    kinds = dict(current.dtypes)
    fresh = source.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*tracked)).alias("_new")).select(key, F.lit(True).alias("_there"), *(F.col(f"_new.{c}").cast(kinds[c]).alias(f"_new_{c}") for c in tracked))
    live, closed = current.filter("is_current"), current.filter("not is_current")
    joined = live.join(fresh, key, "full")
    differs = [~F.col(c).eqNullSafe(F.col(f"_new_{c}")) if null_safe else F.coalesce(F.col(c) != F.col(f"_new_{c}"), F.lit(False)) for c in tracked]
    changed = F.col("_there").isNotNull() & F.col("effective_start_date").isNotNull() & reduce(Column.__or__, differs)
    gone = F.col("_there").isNull() if close_missing else F.lit(False)
    opened = F.col("effective_start_date").isNull()
    stay = F.struct(*(F.col(c).alias(c) for c in columns), F.col("effective_start_date"), F.when(changed | gone, day).otherwise(F.col("effective_end_date")).alias("effective_end_date"), (~(changed | gone)).alias("is_current"))
    start = F.struct(F.col(key).alias(key), *(F.col(f"_new_{c}").alias(c) for c in tracked), day.alias("effective_start_date"), F.lit(OPEN_END).cast("date").alias("effective_end_date"), F.lit(True).alias("is_current"))
    rows = F.when(opened, F.array(start)).when(changed, F.array(stay, start)).otherwise(F.array(stay))
    out = joined.select(F.explode(rows).alias("r")).select("r.*")
    return closed.select(*out.columns).unionByName(out)


def overlap_flags(dim: DataFrame, key: str) -> DataFrame:
    """Every version with ``no_overlap``: it starts at or after the end of the version before."""
    order = Window.partitionBy(key).orderBy("effective_start_date", "effective_end_date")
    before = F.lag(F.coalesce("effective_end_date", F.lit(OPEN_END).cast("date"))).over(order)
    return dim.withColumn("no_overlap", before.isNull() | (F.col("effective_start_date") >= before))


def incremental_fact(delta: DataFrame, stored: DataFrame, key: str, day: str, value: str, per_key_watermark: bool = False) -> DataFrame:
    """Rows of ``delta`` newer than the stored ones, with the change against the row before.

    The first new row of a key is compared with the key's newest stored row (one per key, found by an aggregate); without
    one the change is zero.  The watermark is the newest stored date of all keys, or of each key on request.
    """
    newest = stored.groupBy(key).agg(F.max(day).alias("_last"), F.max_by(value, day).alias("_stored"))
    top = stored.agg(F.max(day).alias("_top"))  # one row
    joined = delta.join(newest, key, "left").join(F.broadcast(top), F.lit(True), "left")
    mark = F.col("_last") if per_key_watermark else F.col("_top")
    fresh = joined.filter(mark.isNull() | (F.col(day) > mark))
    before = F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(day)), "_stored")
    out = fresh.withColumn("previous", before).withColumn("change", F.coalesce(F.col(value) - F.col("previous"), F.lit(0.0)))
    percent = F.when(F.col("previous").isNull() | (F.col("previous") == 0), 0.0).otherwise(F.col("change") / F.col("previous") * 100)
    return out.select(key, day, value, "previous", "change", percent.alias("change_pct"))


def geo_enrich(df: DataFrame, geo: DataFrame, on: str, rename: dict[str, str] | None = None) -> DataFrame:
    return df.join(geo.withColumnsRenamed(rename or {}), on, "left")


def daily_ranking(orders: DataFrame, user: str, at: str, amount: str, as_of: str, lookback: str = "24 hours", top: int | None = None) -> DataFrame:
    """Totals per date and user since ``as_of`` minus the lookback, ranked in each date (ties by user)."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {lookback}")
    totals = orders.filter(F.col(at) >= since).groupBy(F.to_date(at).alias("date"), F.col(user).alias("user_id")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("total"), F.max(F.col(amount)).alias("largest")
    )
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.col("total").desc(), "user_id")))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def top_numbered(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of the whole table, numbered.  The limit comes first, so the window sees n rows only."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def monthly_top(orders: DataFrame, user: str, at: str, amount: str) -> DataFrame:
    totals = orders.groupBy(F.trunc(F.col(at).cast("date"), "month").alias("month"), F.col(user).alias("user_id")).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("revenue"))
    return totals.withColumn("rn", F.row_number().over(Window.partitionBy("month").orderBy(F.col("revenue").desc(), "user_id"))).filter("rn = 1").drop("rn")


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, counting repeats; empty if the two are the same bag of rows."""
    columns = sorted(a.columns)
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("only_in", F.lit("a")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("b")))


def reconcile_user(wide_rows: DataFrame, fact: DataFrame, dim: DataFrame, key: str, business: str, value: str) -> DataFrame:
    """The same business key read from a wide table and from the star, found by a semi join instead of collected keys."""
    star = fact.join(dim.filter(F.col(business) == value).select(key), key, "left_semi")
    return reconcile(wide_rows.filter(F.col(business) == value).select(*star.columns), star)


def pivot_sum(df: DataFrame, key: str, column: str, value: str, values: list | None = None) -> DataFrame:
    """Long to wide; naming the values spares the pass that looks for them."""
    grouped = df.groupBy(key).pivot(column, values) if values else df.groupBy(key).pivot(column)
    return grouped.agg(F.sum(value))


def context_features(orders: DataFrame, user: str, day: str, amount: str, flag: str, reading: str) -> DataFrame:
    """Per user and day: total, distinct rows' count, whether any row is flagged, greatest reading."""
    return orders.groupBy(user, day).agg(
        F.sum(amount).alias("total"), F.count_distinct(F.col("order_id")).alias("orders"), F.max(F.when(F.col(flag), True).otherwise(False)).alias("any_flag"), F.max(reading).alias("top_reading")
    )


def any_of(*conditions: Column) -> Column:
    """Three-valued or: true if one is true, null if none is true and one is unknown."""
    return reduce(Column.__or__, conditions)


def today() -> str:
    return dt.date.today().isoformat()
