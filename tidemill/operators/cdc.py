"""Change log between two snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: list[str]):
    """A hash of all columns that tells null from every value."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def cdc_log(old: DataFrame, new: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Versioned log: the old rows as version 1 (I), then inserts (I), updates (U) and deletes (D, payload null).

    The newest entry of a key is current, a delete included.  Null keys are left out; repeated keys keep their greatest row.
    """
    def reduced(df: DataFrame) -> DataFrame:
        best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*payload)).alias("_p"))
        return best.select(key, "_p.*").withColumn("_hash", row_hash(payload))

    before, after = reduced(old), reduced(new)
    joined = before.select(key, F.struct(*payload).alias("_old"), F.col("_hash").alias("_was")).join(
        after.select(key, F.struct(*payload).alias("_new"), F.col("_hash").alias("_is")), key, "full"
    )
    kind = F.when(F.col("_was").isNull(), "I").when(F.col("_is").isNull(), "D").when(F.col("_was") != F.col("_is"), "U")
    first = F.when(F.col("_was").isNotNull(), F.struct(F.lit(1).alias("version"), F.lit("I").alias("op"), kind.isNull().alias("is_current"), F.col("_old").alias("p")))
    change = F.when(kind.isNotNull(), F.struct(F.when(F.col("_was").isNull(), 1).otherwise(2).alias("version"), kind.alias("op"), F.lit(True).alias("is_current"), F.col("_new").alias("p")))
    entries = F.filter(F.array(first, change), lambda e: e.isNotNull())
    return joined.select(key, F.explode(entries).alias("e")).select(key, "e.version", "e.op", "e.is_current", *(F.col(f"e.p.{c}").alias(c) for c in payload))


def append_changes(log: DataFrame, new: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """An existing log brought up to a further snapshot; touched entries stop being current, versions go on from the
    greatest of their key."""
    latest = log.filter("is_current and op <> 'D'").select(key, *payload)
    top = log.groupBy(key).agg(F.max("version").alias("_top"))
    fresh = cdc_log(latest, new, key, payload)
    changes = fresh.filter("op <> 'I' or version = 1").join(latest.select(key, F.lit(True).alias("_known")), key, "left")
    changes = changes.filter("op <> 'I' or _known is null").drop("_known").join(top, key, "left")
    changes = changes.withColumn("version", F.coalesce(F.col("_top") + 1, F.lit(1))).drop("_top")
    touched = changes.select(key, F.lit(True).alias("_touched"))
    kept = log.join(touched, key, "left").withColumn("is_current", F.col("is_current") & F.col("_touched").isNull()).drop("_touched")
    return kept.unionByName(changes.select(*kept.columns))


def replayed(log: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The snapshot that a log leads to."""
    order = Window.partitionBy(key).orderBy(F.col("version").desc())
    return log.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1 and op <> 'D'").select(key, *payload)
