"""Structured Streaming: parse, deduplicate, window, join, branch, decode and rank."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import scratch
from ..sources.avro import avro_to_json
from ..sources.readers import wire_payload

log = logging.getLogger(__name__)


def kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None, min_partitions: int | None = None, **options: str) -> DataFrame:
    """A topic as a stream of bytes, with optional limits of intake; security settings come in ``options``."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    if min_partitions:
        reader = reader.option("minPartitions", min_partitions)
    return reader.options(**options).load()


def files(spark: SparkSession, pattern: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``max_files`` a trigger plays the part of a limit of offsets."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(pattern)


def parsed(stream: DataFrame, column: str, schema: str, event: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """JSON messages as typed columns, the event time as a timestamp, and the processing time."""
    rows = stream.select(F.from_json(F.col(column).cast("string"), schema).alias("_m")).select("_m.*")
    return rows.withColumn(event, F.try_to_timestamp(event, F.lit(pattern))).withColumn("processing_time", F.current_timestamp())


def deduplicated(stream: DataFrame, keys: list[str], event: str, lateness: str = "10 minutes") -> DataFrame:
    """One message per key within the watermark.  The key is the message id alone: columns that differ from delivery to
    delivery would let repeats through."""
    return stream.withWatermark(event, lateness).dropDuplicatesWithinWatermark(keys)


def sliding(stream: DataFrame, key: str, event: str, amount: str, size: str = "60 minutes", slide: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Count, sum and largest amount per key and window; every event is in size/slide windows, so state grows with that.

    The watermark drops events whose windows are over and lets their state go.
    """
    grouped = stream.withWatermark(event, lateness).groupBy(F.window(event, size, slide).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("total"), F.max(amount).alias("largest")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "orders", "total", "largest"
    )


def static_join(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Left join with a table; its columns should be pruned by the caller.  The optimizer broadcasts it if it is small."""
    return stream.join(static, key, "left")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process what is there and stop."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], seconds: int, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def console(stream: DataFrame, name: str, checkpoint: str, seconds: int = 30, mode: str = "append") -> StreamingQuery:
    """A named query that prints its batches."""
    writer = stream.writeStream.queryName(name).format("console").option("truncate", False).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def collected(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """The whole result of a stream that ends, as a table in the shared folder.

    Each batch writes a folder of its own name, so a repeated batch replaces itself.  In complete mode the last counts, in
    update mode the last row of each of the ``keys``.
    """
    spark, root = stream.sparkSession, scratch(stream.sparkSession, "stream-out")
    last: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number:08d}")
        last.append(number)

    run_to_end(stream, sink, mode, checkpoint)
    if not last:
        return spark.createDataFrame([], stream.schema)
    path = f"{root}/batch={last[-1]:08d}" if mode == "complete" else root
    rows = spark.read.schema(stream.schema).parquet(path)
    if mode == "update":
        others = [c for c in stream.columns if c not in keys]
        rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(root)
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*keys, "_last.*")
    return rows.select(*stream.columns)


def tee(sinks: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One batch for several sinks, computed once; empty batches are skipped."""
    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                for one in sinks:
                    one(batch, number)
        finally:
            batch.unpersist()

    return sink


def branches(stream: DataFrame, parts: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame, int], None]]], checkpoint: str) -> list[StreamingQuery]:
    """Several queries from one parsed stream, each with a checkpoint of its own."""
    return [
        make(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start() for name, (make, sink) in parts.items()
    ]


def versioned_decode(stream: DataFrame, column: str, versions: list[tuple[int, str]], key: str, paths: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(decoded rows with ``schema_version``, rows that no version fits with a null one).

    Versions are tried in order; the first under which the key is not null is taken.  ``paths`` says where a version keeps
    its key, if not under its name.  Reader-compatible formats may decode an older record under a newer schema, so the
    version says which schema fitted first.
    """
    tries = stream
    for number, schema in versions:
        tries = tries.withColumn(f"_v{number}", F.from_json(F.col(column).cast("string"), schema))
    return _first_fit(tries, column, versions, key, paths)


def _first_fit(tries: DataFrame, column: str, versions: list[tuple[int, str]], key: str, paths: dict[int, str] | None) -> tuple[DataFrame, DataFrame]:
    at = {n: F.col(f"_v{n}.{(paths or {}).get(n, key)}") for n, _ in versions}
    tries = tries.withColumn("schema_version", F.coalesce(*(F.when(at[n].isNotNull(), F.lit(n)) for n, _ in versions)))
    fields = {n: StructType.fromDDL(s).names for n, s in versions}
    every = [c for c in dict.fromkeys(c for some in fields.values() for c in some) if c != key]

    def pick(name: str) -> Column:
        return F.coalesce(*(F.when(F.col("schema_version") == n, F.col(f"_v{n}.{name}")) for n, some in fields.items() if name in some)).alias(name)

    found = F.coalesce(*(F.when(F.col("schema_version") == n, c) for n, c in at.items())).alias("id")
    good = tries.filter("schema_version is not null").select(found, *(pick(c) for c in every), "schema_version")
    dead = tries.filter("schema_version is null").select(F.col(column), F.lit(None).cast("int").alias("schema_version"))
    return good, dead


def versioned_avro(stream: DataFrame, column: str, versions: list[tuple[int, str, str]], key: str, paths: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``versioned_decode``, of framed Avro messages; a version is (number, Avro schema, Spark schema of its columns)."""
    tries, payload = stream, wire_payload(F.col(column))
    for number, schema, _ in versions:
        tries = tries.withColumn(f"_json{number}", avro_to_json(payload, schema))
    for number, _, columns in versions:
        tries = tries.withColumn(f"_v{number}", F.from_json(f"_json{number}", columns))
    return _first_fit(tries, column, [(n, c) for n, _, c in versions], key, paths)


def latest_ranking(batch: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Each key's newest window in a batch of window rows, and the n with the largest totals."""
    newest = batch.groupBy(key).agg(F.max(F.struct("window_start", "window_end", "total", "orders")).alias("l")).select(key, "l.*")
    order = [F.col("total").desc(), F.col(key)]
    return newest.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def guarded(sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink whose failures are logged with their batch and raised, so the batch is tried again instead of lost."""
    def run(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception:
            log.exception("batch %s failed", number)
            raise

    return run
