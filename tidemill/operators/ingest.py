"""Source to bronze, and the sinks that tables leave by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.names import nan_to_null, sanitized
from ..sources.readers import day_predicate
from ..sources.store import TableStore


def ingest(
    source: DataFrame, ingest_date: str, key: str, day_column: str | None = None, only_day: str | None = None, renames: dict[str, str] | None = None, numeric: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of one logical date (or all) under canonical names, NaN cleared, with the load date and a 64-bit key hash.

    A null key hashes to null.  Writing the result over its load date's partition makes a repeated load harmless.
    """
    rows = source.filter(day_predicate(day_column, only_day)) if day_column else source
    rows = nan_to_null(sanitized(rows, renames), list(numeric))
    return rows.withColumns({"ingest_date": F.lit(ingest_date).cast("date"), f"{key}_hash": F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))})


@dataclass(frozen=True)
class Extractor:
    """A source and the table it is loaded into."""

    extract: Callable[[SparkSession], DataFrame]
    table: str
    partition: str | None = "ingest_date"

    def run(self, spark: SparkSession, store: TableStore) -> int:
        """Overwrite the partitions that the extract holds; the number of rows now in the table."""
        rows = self.extract(spark)
        if self.partition and self.partition not in rows.columns:
            raise ValueError(f"column {self.partition} is missing")
        if store.pointer(self.table) is None:
            store.create(rows, self.table, [self.partition] if self.partition else [])
        else:
            store.overwrite_partitions(rows, self.table)
        return store.read(self.table).count()


def add_partitions(df: DataFrame, table: str, location: str, partition: str, files: int | None = None) -> list[str]:
    """Write Parquet by partition into an external table of the catalog and register each partition that was written.

    ``files`` fixes the number of writing tasks, which suits small loads; by default their sizes follow the data.

    The values registered are those of the written folders (one per day of a load), not of a pass over the data.
    """
    spark = df.sparkSession
    spread = df.repartition(files, partition) if files else df.hint("rebalance", partition)
    spread.write.mode("overwrite").option("compression", "snappy").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(location)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (`{partition}`) LOCATION '{location}'")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    values = sorted(s.getPath().getName().split("=", 1)[1] for s in listed if "=" in s.getPath().getName())
    for value in values:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (`{partition}` = '{value}')")
    return values


def documents(df: DataFrame, identifier: list[str]) -> DataFrame:
    """Rows as JSON documents with ``_id`` made of the identifier's columns; nulls are left out of a document."""
    columns = [F.concat_ws("-", *(F.col(c).cast("string") for c in identifier)).alias("_id"), *(F.col(f"`{c}`") for c in df.columns)]
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def replace_documents(store: TableStore, df: DataFrame, identifier: list[str], collection: str, env: str | None = None) -> str:
    """Insert or replace each row's document (``_id``, ``value``) in a collection of the run's environment; its name.

    Documents that the rows do not name stay; of several rows for one identifier the greatest holds.
    """
    name = f"{collection}_{env}" if env else collection
    ids = F.concat_ws("-", *(F.col(c).cast("string") for c in identifier))
    docs = df.select(ids.alias("_id"), F.to_json(F.struct(ids.alias("_id"), *(F.col(f"`{c}`") for c in df.columns))).alias("value"))
    docs = docs.groupBy("_id").agg(F.max("value").alias("value"))
    if store.pointer(name) is None:
        store.create(docs, name)
    else:
        store.merge(docs, name, ["_id"])
    return name


def export_documents(df: DataFrame, identifier: list[str], path: str) -> None:
    """Replace the documents at ``path``: one JSON document a line, one per identifier (the greatest row of each)."""
    values = [c for c in df.columns if c not in identifier]
    unique = df.groupBy(*identifier).agg(F.max(F.struct(*values)).alias("_v")).select(*identifier, "_v.*") if values else df.distinct()
    documents(unique, identifier).write.mode("overwrite").text(path)
