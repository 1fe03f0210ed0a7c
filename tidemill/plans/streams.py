"""Streaming queries over files, each run until its input ends."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import table
from ..sources.avro import Registry as SchemaRegistry
from ..sources.avro import encoded
from ..streaming import pipeline as p
from . import Registry

REGISTRY = query = Registry()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream, its times cast for watermarks.  (The source takes a lone file only by a pattern.)"""
    schema = table(spark, folder, "events").schema
    return p.files(spark, f"{folder}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def delivered(spark: SparkSession, folder: str, copies: bool = False) -> DataFrame:
    """The events as a stream of four deliveries by day, one a trigger.

    Every 97th event of the first delivery comes with the last one, days after its windows are over.  With ``copies`` each
    delivery also brings the events of the one before once more.
    """
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    due = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int")
    number = F.when((due == 0) & (F.col("event_id") % 97 == 0), 3).otherwise(due)
    numbers = F.array(number, number + 1) if copies else F.array(number)
    root = scratch(spark, "deliveries")
    for n in range(5 if copies else 4):
        rows.withColumn("_n", F.explode(numbers)).filter(F.col("_n") == n).drop("_n").coalesce(1).write.parquet(f"{root}/d={n}")
    return p.files(spark, f"{root}/*", rows.schema, max_files=1)


#: Events that came too late: those of the first delivery that the last one brought.
_LATE = "(least(3, (day(ts) - 1) // 8) = 0 and event_id % 97 = 0)"


@query("stream_sliding_window", f"""
with e as (select user_id, value, time_bucket(interval 30 minute, ts) - k * interval 30 minute as start from events, (values (0), (1)) s(k) where not {_LATE})
select user_id, strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as orders, cast(sum(cast(value as decimal(18,2))) as double) as total, max(value) as largest from e group by 1, 2""")
def stream_sliding_window(spark: SparkSession, folder: str) -> DataFrame:
    """Windows in update mode over several batches; events that come days late are dropped by the watermark."""
    out = p.collected(p.sliding(delivered(spark, folder), "user_id", "ts", "value", "60 minutes", "30 minutes"), "update", ["window_start", "window_end", "user_id"])
    return out.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "orders", F.col("total").cast("double").alias("total"), "largest")


@query("stream_dedup", "select event_id, user_id from events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event delivered twice, in two batches, comes out once."""
    return p.collected(p.deduplicated(delivered(spark, folder, copies=True), ["event_id"], "ts", "60 days")).select("event_id", "user_id")


@query("stream_static_join", "select event_id, c_name, c_mktsegment from events left join customer on user_id = c_custkey")
def stream_static_join(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return p.collected(p.static_join(events(spark, folder), users, "user_id").select("event_id", "c_name", "c_mktsegment"))


@query("stream_tee", "select 'table' as sink, event_type, count(*) as n from events group by 2 union all select 'copy', event_type, count(*) from events group by 2")
def stream_tee(spark: SparkSession, folder: str) -> DataFrame:
    """One stream into two sinks, each batch computed once."""
    roots = {name: scratch(spark, f"tee-{name}") for name in ("table", "copy")}
    write = lambda root: lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
    stream = events(spark, folder).select("event_id", "event_type")
    p.run_to_end(stream, p.tee([write(r) for r in roots.values()]))
    read = [spark.read.schema(stream.schema).parquet(root).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("sink", F.lit(name)) for name, root in roots.items()]
    return read[0].unionByName(read[1])


@query("stream_branches", "select 'good' as branch, count(*) as n from events where event_type <> 'error' union all select 'errors', count(*) from events where event_type = 'error'")
def stream_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Two queries from one parsed stream."""
    roots = {name: scratch(spark, f"branch-{name}") for name in ("good", "errors")}
    write = lambda root: lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
    stream = events(spark, folder).select("event_id", "event_type")
    parts = {"good": (lambda s: s.filter("event_type <> 'error'"), write(roots["good"])), "errors": (lambda s: s.filter("event_type = 'error'"), write(roots["errors"]))}
    for running in p.branches(stream, parts, scratch(spark, "branches")):
        running.awaitTermination()
    count = [spark.read.schema(stream.schema).parquet(root).agg(F.count(F.lit(1)).alias("n")).withColumn("branch", F.lit(name)) for name, root in roots.items()]
    return count[0].unionByName(count[1])


#: Version 2 has a kind of its own and a parent; a message of version 1 lacks the kind, so version 2 leaves its key null.
VERSIONS = [(2, "key struct<id:bigint>, user_id bigint, parent_id string"), (1, "key bigint, user_id bigint")]


def _decode(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events as JSON of two versions, every eleventh broken."""
    newer = F.to_json(F.struct(F.struct(F.col("event_id").alias("id")).alias("key"), "user_id", F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("parent_id")))
    older = F.to_json(F.struct(F.col("event_id").alias("key"), "user_id"))
    value = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).when(F.col("event_id") % 2 == 0, newer).otherwise(older)
    good, dead = p.versioned_decode(events(spark, folder).select(value.alias("value")), "value", VERSIONS, "key", {2: "key.id", 1: "key"})
    return good, dead


@query("versioned_decode_good", """
select event_id as id, user_id, case when event_id % 2 = 0 then 'p' || event_id end as parent_id, case when event_id % 2 = 0 then 2 else 1 end as schema_version from events where event_id % 11 <> 0""")
def versioned_decode_good(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = _decode(spark, folder)
    return p.collected(good)


@query("versioned_decode_dlq", "select '{broken ' || event_id as value, cast(null as int) as schema_version from events where event_id % 11 = 0")
def versioned_decode_dlq(spark: SparkSession, folder: str) -> DataFrame:
    _, dead = _decode(spark, folder)
    return p.collected(dead)


@query("stream_latest_ranking", """
with w as (select user_id, time_bucket(interval 60 minute, ts) as start, sum(cast(value as decimal(18,2))) as total from events group by 1, 2),
l as (select * from w qualify row_number() over (partition by user_id order by start desc) = 1)
select user_id, cast(total as double) as total, cast(row_number() over (order by total desc, user_id) as int) as rank from l qualify rank <= 10""")
def stream_latest_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Windows from the stream, then each user's newest one ranked over the whole state."""
    stream = p.sliding(events(spark, folder), "user_id", "ts", "value", "60 minutes", "60 minutes", "60 days")
    windows = p.collected(stream, "update", ["window_start", "window_end", "user_id"])
    return p.latest_ranking(windows, "user_id", 10).select("user_id", F.col("total").cast("double").alias("total"), "rank")


_RECORD = {"type": "record", "name": "event"}
_KEY = {"type": "record", "name": "key", "fields": [{"name": "id", "type": "long"}]}
AVRO_V2 = json.dumps(_RECORD | {"fields": [{"name": "key", "type": _KEY}, {"name": "user_id", "type": ["null", "long"]}, {"name": "parent_id", "type": ["null", "string"], "default": None}]})
AVRO_V1 = json.dumps(_RECORD | {"fields": [{"name": "key", "type": "string"}, {"name": "user_id", "type": ["null", "long"]}]})


def _answer(url: str) -> str:
    """A registry that knows the two versions of one subject."""
    return json.dumps({"schema": {"2": AVRO_V2, "1": AVRO_V1}[url.rsplit("/", 1)[1]]})


def _avro(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events as Avro messages of two versions, some of them sent once more but cut short, decoded by the schemas that a registry gives."""
    rows = table(spark, folder, "events").select("event_id", "user_id")
    newer = rows.filter("event_id % 2 = 0").select(F.struct(F.col("event_id").alias("id")).alias("key"), "user_id", F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("parent_id"))
    older = rows.filter("event_id % 2 = 1").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), "user_id")
    root = scratch(spark, "avro")
    whole = encoded(newer, AVRO_V2, 7).unionByName(encoded(older, AVRO_V1, 3))
    cut = encoded(newer.filter("key.id % 11 = 0"), AVRO_V2, 7).select(F.substring("value", 1, 6).alias("value"))
    whole.unionByName(cut).write.parquet(root)
    stream = p.files(spark, root, "value binary", 2)
    schemas = dict(SchemaRegistry("http://registry.example", _answer).versions("events-value"))
    versions = [(2, schemas[2], "key struct<id:string>, user_id bigint, parent_id string"), (1, schemas[1], "key string, user_id bigint")]
    return p.versioned_avro(stream, "value", versions, "key", {2: "key.id", 1: "key"})


@query("avro_decoded", """
select case when event_id % 2 = 0 then 2 else 1 end as schema_version, count(*) as messages, case when event_id % 2 = 0 then count(*) else 0 end as parents from events group by event_id % 2
union all select null, count(*), 0 from events where event_id % 22 = 0""")
def avro_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """How many messages decode under which version, and how many under none."""
    good, dead = (p.collected(part) for part in _avro(spark, folder))
    return good.groupBy("schema_version").agg(F.count(F.lit(1)).alias("messages"), F.count("parent_id").alias("parents")).unionByName(
        dead.groupBy("schema_version").agg(F.count(F.lit(1)).alias("messages"), F.lit(0).cast("bigint").alias("parents"))
    )


@query("stream_processing_time", "select count(*) as rows, count(distinct event_id) as events from events")
def stream_processing_time(spark: SparkSession, folder: str) -> DataFrame:
    """A stream on a processing-time trigger, stopped when it has caught up and started again from its checkpoint."""
    root, place = scratch(spark, "timed"), scratch(spark, "timed-state")
    stream = delivered(spark, folder).select("event_id")
    for _ in range(2):  # the second run finds nothing new
        running = p.start(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batch={number}"), 1, place)
        running.processAllAvailable()
        running.stop()
    return spark.read.schema(stream.schema).parquet(root).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("events"))


@query("json_parse_stream", "select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at, user_id from events")
def json_parse_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON messages from a stream as typed columns."""
    text = F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "user_id"))
    rows = p.parsed(events(spark, folder).select(text.alias("value")), "value", "event_id bigint, at string, user_id bigint", "at")
    return p.collected(rows.drop("processing_time")).select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "user_id")
