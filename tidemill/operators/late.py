"""Totals per period of event time that late records correct until a cut-off.

Each new batch of raw events is handled the same way: its rows are judged against the watermark, admitted rows join the
retained raw events, the partitions (days of event time) they touch are recomputed entirely from those, and a manifest
swap by rename makes the new partitions visible at once.  Readers see the old state or the new one, never a mixture; a
batch that is applied again after a failure writes the same files anew.

A raw batch is all rows with one ingest time; its watermark is the greatest usable event time of all earlier batches minus
the allowed lateness (none before the first).  An event time is usable if it is there and not after the row's ingest time.
A row is late if its period ends at or before its batch's watermark.

Defined results: rows without usable event time or ingest time are retained as ``unusable`` and count nowhere; rows that
are not ``kept`` are retained as ``duplicate`` (their event time still moves the watermark); null and NaN amounts count as
an event without amount; an empty table gives no periods.
"""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import discard, materialize

LATENESS_HOURS = 2
#: Folders of batches from which on they are written together.
COMPACT_AT = 16


def usable(event: str, ingest: str) -> Column:
    return F.coalesce(F.col(event) <= F.col(ingest), F.lit(False))


def hour_of(event: str) -> Column:
    return F.date_trunc("hour", F.col(event)).cast("timestamp_ntz")


def batch_tops(rows: DataFrame, event: str, ingest: str) -> DataFrame:
    """Per ingest time the greatest usable event time of its rows (``_top``)."""
    seen = F.when(usable(event, ingest), F.col(event))
    return rows.filter(F.col(ingest).isNotNull()).groupBy(ingest).agg(F.max(seen).alias("_top"))


def batch_watermarks(tops: DataFrame, ingest: str, before: dt.datetime | None = None) -> DataFrame:
    """Per ingest time the greatest usable event time of all earlier ones (``before`` carries over from earlier calls).

    The running maximum is taken in two steps, over days and inside a day, so that no task sorts all batches.
    """
    batches = tops.withColumn("_day", F.to_date(ingest))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar day
    days = batches.groupBy("_day").agg(F.max("_top").alias("_of_day"))
    days = days.select("_day", F.greatest(F.max("_of_day").over(earlier), F.lit(before).cast("timestamp_ntz")).alias("_carry"))
    inside = Window.partitionBy("_day").orderBy(ingest).rowsBetween(Window.unboundedPreceding, -1)
    joined = batches.join(days, "_day")
    return joined.select(ingest, F.greatest(F.max("_top").over(inside), "_carry").alias("seen_before"))


def judge(rows: DataFrame, event: str, ingest: str, hours: int = LATENESS_HOURS, before: dt.datetime | None = None, tops: DataFrame | None = None) -> DataFrame:
    """``status`` of every row: admitted, late, duplicate or unusable.  ``rows`` has a boolean ``kept``."""
    marks = batch_watermarks(batch_tops(rows, event, ingest) if tops is None else tops, ingest, before)
    joined = rows.drop("seen_before").join(marks, ingest, "left")
    wm = F.col("seen_before") - F.expr(f"INTERVAL {int(hours)} HOURS")
    late = F.coalesce(hour_of(event) + F.expr("INTERVAL 1 HOUR") <= wm, F.lit(False))
    status = F.when(~F.col("kept"), "duplicate").when(~usable(event, ingest), "unusable").when(late, "late").otherwise("admitted")
    return joined.withColumn("status", status).drop("seen_before")


class PeriodTotals:
    """Hourly totals in a folder: retained raw events, versioned partitions and a manifest."""

    def __init__(self, spark: SparkSession, root: str, event: str = "created_at", ingest: str = "ingest_ts", cents: str = "cents", hours: int = LATENESS_HOURS) -> None:
        self.spark, self.root, self.event, self.ingest, self.cents, self.hours = spark, root, event, ingest, cents, hours
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def manifest(self) -> dict:
        """The visible state: batches applied, greatest usable event time, and the version of each day's partition."""
        path = self._path(f"{self.root}/manifest.json")
        if not self._fs.exists(path):
            return {"batches": [], "seen": None, "days": {}, "raw": {}, "schema": None}
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        fresh = self._path(f"{self.root}/manifest.next")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._path(f"{self.root}/manifest.json")), overwrite)

    def apply(self, batch: DataFrame, name: str) -> None:
        """Take in the rows of one or more raw batches; they must all be later than those taken in before."""
        state = self.manifest()
        if name in state["batches"]:
            return
        before = dt.datetime.fromisoformat(state["seen"]) if state["seen"] else None
        tops = materialize(batch_tops(batch, self.event, self.ingest), "late-tops")  # one row per ingest time
        judged = judge(batch, self.event, self.ingest, self.hours, before, tops).withColumn("event_day", F.when(F.col("status") == "admitted", F.to_date(self.event)))
        raw = f"{self.root}/raw/{name}"
        judged.hint("rebalance", "status", "event_day").write.mode("overwrite").partitionBy("status", "event_day").parquet(raw)
        seen = max((x for x in (before, tops.agg(F.max("_top")).first()[0]) if x), default=None)
        discard(tops)
        touched = self._days(f"raw/{name}/status=admitted")  # calendar days
        held = state["raw"] | {d: [*state["raw"].get(d, []), name] for d in touched}
        if touched:
            self._totals(self._admitted(held, touched, judged.schema)).hint("rebalance", "event_day").write.mode("overwrite").partitionBy("event_day").parquet(f"{self.root}/totals/{name}")
        days = state["days"] | {d: name for d in touched}
        stored = [*(state.get("stored") or state["batches"]), name]
        self._publish({"batches": [*state["batches"], name], "stored": stored, "seen": seen and seen.isoformat(), "days": days, "raw": held, "schema": judged.schema.json()})
        if len(stored) >= COMPACT_AT:
            self.compact()

    def _days(self, folder: str) -> list[str]:
        """The days that a written folder has partitions of."""
        place = self._path(f"{self.root}/{folder}")
        found = [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []
        return sorted(n.split("=", 1)[1] for n in found if n.startswith("event_day=") and "__HIVE" not in n)

    def compact(self) -> None:
        """Write the folders of all batches as one, so that plans do not grow with the number of batches.

        Readers keep the old folders, which are not removed here, until the manifest names the new one.
        """
        state = self.manifest()
        stored = state.get("stored") or state["batches"]
        if len(stored) < 2:
            return
        name = f"compact-{len(state['batches']):05d}"
        self.retained().hint("rebalance", "status", "event_day").write.mode("overwrite").partitionBy("status", "event_day").parquet(f"{self.root}/raw/{name}")
        if state["days"]:
            self.totals().withColumn("event_day", F.to_date("hour")).hint("rebalance", "event_day").write.mode("overwrite").partitionBy("event_day").parquet(f"{self.root}/totals/{name}")
        self._publish(state | {"stored": [name], "days": dict.fromkeys(state["days"], name), "raw": {d: [name] for d in state["raw"]}})

    def _admitted(self, held: dict[str, list[str]], days: list[str], schema) -> DataFrame:
        """The retained raw events of some days, read from the batches that have any, and from nothing else."""
        paths: dict[str, list[str]] = {}
        for day in days:
            for name in held[day]:
                paths.setdefault(name, []).append(f"{self.root}/raw/{name}/status=admitted/event_day={day}")
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.root}/raw/{n}").parquet(*found) for n, found in paths.items()]
        return reduce(DataFrame.unionByName, parts)

    def _totals(self, admitted: DataFrame) -> DataFrame:
        return admitted.groupBy("event_day", hour_of(self.event).alias("hour")).agg(
            F.count(F.lit(1)).alias("orders"), F.count(self.cents).alias("amounts"), F.sum(self.cents).alias("cents")
        )

    def retained(self, names: list[str] | None = None, schema=None) -> DataFrame:
        """All raw events ever taken in, with their status."""
        state = self.manifest()
        schema = schema or StructType.fromJson(json.loads(state["schema"]))
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.root}/raw/{n}").parquet(f"{self.root}/raw/{n}") for n in names or state.get("stored") or state["batches"]]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def totals(self) -> DataFrame:
        """The visible totals of all periods."""
        state = self.manifest()
        kind = "hour timestamp_ntz, orders bigint, amounts bigint, cents bigint"
        whole = self.spark.createDataFrame([], kind)
        for version in sorted(set(state["days"].values())):
            paths = [f"{self.root}/totals/{version}/event_day={d}" for d, v in state["days"].items() if v == version]
            whole = whole.unionByName(self.spark.read.schema(kind).parquet(*paths))
        return whole


def replay(store: PeriodTotals, rows: DataFrame, live: int = 2, last_day: dt.date | None = None) -> PeriodTotals:
    """Feed a whole table to the store in order of ingest time: the backlog in one call, then each of the ``live`` last days.

    Inside a call every ingest time is still a batch of its own with its own watermark, so the result does not depend on
    ``live``.  The rows are laid out once by call, so each call reads its own part only.
    """
    high = last_day or rows.agg(F.max(F.to_date(store.ingest))).first()[0]
    start = (high or dt.date(1970, 1, 1)) - dt.timedelta(days=live)
    number = F.coalesce(F.greatest(F.lit(0), F.datediff(F.to_date(store.ingest), F.lit(start))), F.lit(0))
    parts = materialize(rows.withColumn("_call", number), "late-calls", partition_by=["_call"])
    for call in range(live + 1 if high else 1):
        store.apply(parts.filter(F.col("_call") == call).drop("_call"), f"b{call:05d}")
    discard(parts)
    return store
