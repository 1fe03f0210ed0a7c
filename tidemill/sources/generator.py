"""Order messages with planted defects, as a function of their number, for tests of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defects by the remainder of the order's number modulo 100.
DEFECTS = {3: "total_off", 7: "orphan_user", 11: "unit_error", 13: "null_subtotal", 17: "null_tax", 19: "nan_tax", 23: "zero_quantity", 29: "zone_in_time"}


#: A random (version 4) UUID in its canonical spelling, in either case.
UUID4 = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def orders(spark: SparkSession, n: int, users: int = 100, start: str = "2025-01-01 00:00:00") -> DataFrame:
    """``n`` orders; column ``defect`` names what is wrong with a row, null if nothing is."""
    return orders_of(spark.range(n), users, start)


def order_stream(spark: SparkSession, per_second: int = 10, users: int = 100) -> DataFrame:
    """Orders without end, as a stream."""
    return orders_of(spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("id")), users)


def orders_of(ids: DataFrame, users: int = 100, start: str = "2025-01-01 00:00:00") -> DataFrame:
    """The order of each number ``id``."""
    k = F.col("id")
    kind = F.create_map(*(F.lit(x) for pair in DEFECTS.items() for x in pair))[(k % 100).cast("int")]
    rows = ids.withColumn("defect", kind)
    subtotal = (k % 500 + 1).cast("double")
    is_ = lambda name: F.coalesce(F.col("defect") == name, F.lit(False))
    quantity = F.when(is_("zero_quantity"), 0).otherwise((k % 5 + 1).cast("int"))
    tax = F.when(is_("null_tax"), None).when(is_("nan_tax"), float("nan")).otherwise(F.round(subtotal * 0.1, 2))
    total = F.round(subtotal * 1.1, 2) * F.when(is_("unit_error"), 100).otherwise(1) + F.when(is_("total_off"), 1.0).otherwise(0.0)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + k * 60)
    text = F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.when(is_("zone_in_time"), "+09:00").otherwise(""))
    return rows.select(
        F.concat(F.lit("order-"), k.cast("string")).alias("order_id"), F.when(is_("orphan_user"), users + k + 1).otherwise(k % users + 1).cast("int").alias("user_id"),
        F.when(is_("null_subtotal"), None).otherwise(subtotal).alias("subtotal_usd"), tax.alias("tax_usd"), total.alias("total_usd"), quantity.alias("quantity"), text.alias("created_at"), "defect",
    )


def as_messages(rows: DataFrame, versions: bool = True) -> DataFrame:
    """Orders as JSON messages; every other one in the newer shape with a parent id."""
    plain = F.struct(*(c for c in rows.columns if c != "defect"))
    newer = F.struct(*(c for c in rows.columns if c != "defect"), F.lit(None).cast("string").alias("parent_id"))
    even = F.pmod(F.xxhash64("order_id"), F.lit(2)) == 0
    return rows.select(F.when(even & F.lit(versions), F.to_json(newer, {"ignoreNullFields": "false"})).otherwise(F.to_json(plain)).alias("value"))


def validated(rows: DataFrame, identifier: str, quantity: str) -> tuple[DataFrame, DataFrame]:
    """What a producer may send, and what it refuses, with ``reason``: an identifier that is no version-4 UUID, or no positive quantity."""
    bad_id = ~F.coalesce(F.col(identifier).rlike(UUID4), F.lit(False))
    bad_quantity = ~F.coalesce(F.col(quantity) > 0, F.lit(False))
    told = rows.withColumn("reason", F.when(bad_id, "identifier").when(bad_quantity, "quantity"))
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.drop("defect").write.mode("overwrite").option("header", True).csv(path)


def write_jdbc(rows: DataFrame, url: str, table: str) -> None:
    rows.drop("defect").write.format("jdbc").mode("append").options(url=url, dbtable=table).save()
