"""Run context, dependency-ordered jobs, plan inspection and lineage events read from plans."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import MAIN, branch_name


@dataclass(frozen=True)
class RunContext:
    """What a run is about: its date, environment, write mode, and the tables it knows by name."""

    ingest_date: str | None = None
    env: str = MAIN
    mode: str | None = None
    tables: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> str:
        """Full name of a known table for this run."""
        if name not in self.tables:
            raise AttributeError(f"no table is called {name}")
        return branch_name(self.tables[name], self.mode, self.env)

    def day(self, logical: dt.date | None = None, events: list[dt.datetime] = ()) -> str:
        """The given date, else the logical one, else that of the first triggering event."""
        if self.ingest_date:
            return self.ingest_date
        if logical:
            return logical.isoformat()
        if events:
            return min(events).date().isoformat()
        raise ValueError("the run has no date")


@dataclass
class Job:
    run: Callable[[RunContext], None]
    after: tuple[str, ...] = ()
    branch_only: bool = False  # skipped on the main branch, as bootstrap and cleanup are


def run_jobs(jobs: dict[str, Job], context: RunContext) -> list[str]:
    """Run every job after those it depends on; the names in the order they ran."""
    done: list[str] = []
    left = dict(jobs)
    while left:
        ready = [n for n, j in left.items() if all(a in done for a in j.after)]
        if not ready:
            raise ValueError(f"jobs wait for each other: {sorted(left)}")
        for name in ready:
            job = left.pop(name)
            if not (job.branch_only and context.env == MAIN):
                job.run(context)
            done.append(name)
    return done


def run_ddl(spark: SparkSession, statements: list[str], go_on: bool = True) -> list[str]:
    """Run statements in order; with ``go_on`` a failing one is reported and the rest still run."""
    failed = []
    for statement in statements:
        try:
            spark.sql(statement)
        except Exception as error:  # noqa: BLE001
            if not go_on:
                raise
            failed.append(f"{statement.split(chr(10))[0][:80]}: {type(error).__name__}")
    return failed


def table_ddl(name: str, schema: str, partition: list[str] | None = None, properties: dict[str, str] | None = None, comment: str | None = None, identifier: list[str] | None = None, using: str = "parquet") -> list[str]:
    """Statements that make a table: columns, partitions, comment, properties, and its identifier.

    Catalogs without row-level tables have no statement for identifier fields, so these are kept as a property.
    """
    quote = lambda text: "'" + str(text).replace("'", "\\'") + "'"
    told = dict(properties or {}) | ({"identifier.fields": ",".join(identifier)} if identifier else {})
    parts = [f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING {using}"]
    if partition:
        parts.append("PARTITIONED BY (" + ", ".join(f"`{c}`" for c in partition) + ")")
    if comment:
        parts.append(f"COMMENT {quote(comment)}")
    if told:
        parts.append("TBLPROPERTIES (" + ", ".join(f"{quote(k)} = {quote(v)}" for k, v in told.items()) + ")")
    return ["\n".join(parts)]


def create_namespaces(spark: SparkSession, pairs: list[str]) -> None:
    """``name=location`` tokens, or a name alone."""
    for pair in pairs:
        name, _, location = pair.partition("=")
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a namespace: {name!r}")
        where = " LOCATION '" + location.replace("'", "") + "'" if location else ""
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name}{where}")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text, without running it."""
    kind = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(kind)


def scanned(df: DataFrame) -> list[str]:
    """The files' folders that a frame reads."""
    return sorted({re.sub(r"/[^/]*\.parquet/part-[^/]*$|/part-[^/]*$", "", f) for f in df.inputFiles()})


def filters_on(df: DataFrame, column: str) -> bool:
    """Whether the optimized plan filters on a column."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(re.search(rf"\b{re.escape(column)}#\d+", line) for line in plan.splitlines() if re.search(r"\bFilter\b", line))


def require_partition_filter(df: DataFrame, column: str) -> DataFrame:
    """The frame itself, if it filters on its partition column."""
    if not filters_on(df, column):
        raise ValueError(f"the query must filter on {column}")
    return df


def lineage_event(job: str, df: DataFrame, output: str, context: RunContext) -> str | None:
    """A JSON event of inputs and output; only runs on the main branch report."""
    if context.env != MAIN:
        return None
    return json.dumps({"job": job, "inputs": scanned(df), "output": output, "columns": df.columns, "date": context.ingest_date}, ensure_ascii=False)
