"""Tables as immutable snapshots with a pointer per branch, for a catalog that has no row-level statements.

``<root>/<table>/data/<snapshot>/`` holds Parquet, ``<root>/<table>/refs/<branch>/<version>.json`` names the snapshot a
branch shows; the greatest version counts.  A write makes a snapshot and then moves the pointer once, by renaming a file to
the next version, so a job can read the table it writes and readers see the old state or the new one.  A rename to a version
that exists fails: of two writers that began from the same state one gets ``Conflict`` and must begin anew.  A partitioned snapshot lists its partitions by path, and those that a write leaves alone are carried
over by reference, so overwriting a few partitions rewrites nothing else.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAIN = "main"
#: Versions of a pointer that are kept for readers that are about to open them.
KEPT_VERSIONS = 10


class Conflict(RuntimeError):
    """Another writer moved the pointer meanwhile."""


def branch_name(table: str, mode: str | None, env: str | None) -> str:
    """Name of a table for a run: on its branch, or of its empty clone in the development catalog.

    Unknown modes and missing arguments give the plain name, as does a clone of a name without three parts.
    """
    if not env:
        return table
    if mode == "BRANCH":
        return table if env == MAIN else f"{table}.branch_{env}"
    if mode == "ZERO_COPY":  # in every environment, so that such a run never writes a table of production
        parts = table.split(".", 2)
        return f"dev_{parts[0]}.{parts[1]}_{env}.{parts[2]}.branch_{env}" if len(parts) == 3 else table
    return table


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _point(self, table: str, branch: str, state: dict, seen: dict | None) -> None:
        """Move a pointer from the state ``seen`` (None: there is none) by an atomic rename to the next version."""
        version = (seen["version"] if seen else 0) + 1
        folder = f"{table}/refs/{branch}"
        fresh, place = self._path(f"{folder}/{uuid.uuid4().hex}.next"), self._path(f"{folder}/{version:012d}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(state | {"version": version}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(fresh).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(place), options)
        except Py4JJavaError as error:
            self._fs.delete(fresh, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"{table} changed on branch {branch}") from error
            raise
        if version > KEPT_VERSIONS:
            self._fs.delete(self._path(f"{folder}/{version - KEPT_VERSIONS:012d}.json"), False)

    def _versions(self, table: str, branch: str) -> list[str]:
        folder = self._path(f"{table}/refs/{branch}")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json"))

    def _get(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    # reading

    def pointer(self, table: str, branch: str = MAIN) -> dict | None:
        versions = self._versions(table, branch)
        return json.loads(self._get(f"{table}/refs/{branch}/{versions[-1]}")) if versions else None

    def read(self, table: str, branch: str = MAIN) -> DataFrame:
        """The table as a branch shows it; a branch that never wrote shows what it was made from."""
        state = self._state(table, branch)
        return self._read_paths(table, state, state["paths"])

    def _state(self, table: str, branch: str) -> dict:
        state = self.pointer(table, branch)
        if state is None:
            raise ValueError(f"table {table} has no branch {branch}")
        return state

    def _read_paths(self, table: str, state: dict, chosen: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        if not chosen:
            return self.spark.createDataFrame([], schema)
        groups: dict[str, list[str]] = {}
        for path in chosen:
            groups.setdefault(path.split("/", 1)[0], []).append(path)
        base = f"{self.root}/{table}/data"
        parts = [self.spark.read.schema(schema).option("basePath", f"{base}/{s}").parquet(*(f"{base}/{p}" for p in paths)) for s, paths in groups.items()]
        return reduce(DataFrame.unionByName, parts).select(*schema.names)

    # writing

    def _data(self, df: DataFrame, table: str, partition_by: list[str]) -> list[str]:
        """Write a snapshot that no pointer shows yet; its paths."""
        snapshot = uuid.uuid4().hex
        target = f"{self.root}/{table}/data/{snapshot}"
        if partition_by:
            # adaptive execution splits a partition that holds a large part of the rows and joins small ones
            df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(target)
        else:
            df.write.parquet(target)
        return [f"{snapshot}/{p}" for p in self._partitions(f"{table}/data/{snapshot}", len(partition_by))] if partition_by else [snapshot]

    def _write(self, df: DataFrame, table: str, branch: str, partition_by: list[str], seen: dict | None, keep: list[str] | None = None) -> None:
        written = self._data(df, table, partition_by)
        self._point(table, branch, {"schema": df.schema.json(), "partition_by": partition_by, "paths": [*(keep or []), *written], "at": time.time()}, seen)

    def _partitions(self, folder: str, depth: int) -> list[str]:
        found = [""]
        for _ in range(depth):
            deeper: list[str] = []
            for name in found:
                for status in self._fs.listStatus(self._path(f"{folder}/{name}".rstrip("/"))):
                    if status.isDirectory():
                        deeper.append(f"{name}/{status.getPath().getName()}".lstrip("/"))
            found = deeper
        return found

    def create(self, df: DataFrame, table: str, partition_by: list[str] | None = None, branch: str = MAIN) -> None:
        """Replace the whole table."""
        self._write(df, table, branch, partition_by or [], self.pointer(table, branch))

    def overwrite_partitions(self, df: DataFrame, table: str, branch: str = MAIN, require: str | None = None) -> None:
        """Replace the partitions that occur in ``df`` and no others; an unpartitioned table is replaced whole."""
        if require and require not in df.columns:
            raise ValueError(f"column {require} is missing")
        state = self.pointer(table, branch)
        by = state["partition_by"] if state else []
        if not state or not by:
            return self._write(df, table, branch, by, state)
        written = self._data(df, table, by)
        replaced = {p.split("/", 1)[1] for p in written}
        kept = sorted(p for p in state["paths"] if p.split("/", 1)[1] not in replaced)
        self._point(table, branch, {"schema": df.schema.json(), "partition_by": by, "paths": kept + written, "at": time.time()}, state)

    def append(self, df: DataFrame, table: str, branch: str = MAIN) -> None:
        """Add rows; new columns widen the schema and are null in older rows."""
        state = self.pointer(table, branch)
        if state is None:
            return self._write(df, table, branch, [], None)
        old = StructType.fromJson(json.loads(state["schema"]))
        fresh = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in old.fields if f.name not in df.columns})
        fresh = fresh.select(*old.names, *(c for c in fresh.columns if c not in old.names))
        self._write(fresh, table, branch, state["partition_by"], state, state["paths"])

    def _touched(self, table: str, state: dict, source: DataFrame, keys: list[str], arriving: bool) -> tuple[DataFrame, list[str]]:
        """(the target's rows in the partitions that a merge changes, the paths of all other partitions).

        Only keys and partition columns are read to find them; their list is as long as the table has partitions at most.
        """
        target, by = self._read_paths(table, state, state["paths"]), state["partition_by"]
        if not by:
            return target, []
        parts = target.select(*dict.fromkeys([*keys, *by])).join(source.select(*keys), keys, "left_semi").select(*by)
        if arriving:
            parts = parts.unionByName(source.select(*by))
        names = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        listed = parts.distinct().collect()
        changed = {"/".join(names.getPartitionPathString(c, None if r[c] is None else str(r[c])) for c in by) for r in listed}
        paths = [p for p in state["paths"] if p.split("/", 1)[1] not in changed]
        inside = self._read_paths(table, state, [p for p in state["paths"] if p.split("/", 1)[1] in changed])
        return inside, paths

    def merge(self, source: DataFrame, table: str, keys: list[str], branch: str = MAIN) -> None:
        """Upsert: matched rows take the source's values, others are added.  Duplicate or null source keys are an error,
        because which of their rows should win is undefined.  Of a partitioned table only the partitions that matched or
        arriving rows are in are written anew."""
        clash = source.groupBy(*keys).count().filter(reduce(Column.__or__, (F.col(k).isNull() for k in keys), F.col("count") > 1))
        if not clash.isEmpty():
            raise ValueError("the source has null keys or several rows for a key")
        state = self._state(table, branch)
        target, kept = self._touched(table, state, source, keys, arriving=True)
        merged = target.join(source.select(*keys), keys, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))
        self._write(merged, table, branch, state["partition_by"], state, kept)

    def merge_update(self, source: DataFrame, table: str, keys: list[str], assign: dict[str, Column], branch: str = MAIN) -> None:
        """Update matched rows only.  ``assign`` may refer to source columns as ``source.<name>``, not to partition columns."""
        state = self._state(table, branch)
        by = state["partition_by"]
        if set(by) & assign.keys():
            raise ValueError("a partition column cannot be assigned")
        target, kept = self._touched(table, state, source, keys, arriving=False)
        hit = source.withColumn("_hit", F.lit(True)).alias("source")
        condition = reduce(Column.__and__, (F.col(f"target.{k}") == F.col(f"source.{k}") for k in keys))
        joined = target.alias("target").join(hit, condition, "left")
        columns = [F.when(F.col("source._hit"), assign[c]).otherwise(F.col(f"target.{c}")).alias(c) if c in assign else F.col(f"target.{c}") for c in target.columns]
        self._write(joined.select(*columns), table, branch, by, state, kept)

    # branches

    def branch(self, table: str, env: str) -> None:
        """A branch shows the main table's snapshot until it writes; no data is copied."""
        state = self.pointer(table)
        if state is None:
            raise ValueError(f"no table {table}")
        self._point(table, env, state, self.pointer(table, env))

    def clone_empty(self, table: str, clone: str) -> None:
        """The same columns and partitioning without rows."""
        state = self.pointer(table)
        self._point(clone, MAIN, state | {"paths": [], "at": time.time()}, self.pointer(clone))

    def teardown(self, table: str, env: str, buffer_s: float = 300) -> int:
        """Drop a branch and remove snapshots that nothing refers to and that are older than the buffer."""
        self._fs.delete(self._path(f"{table}/refs/{env}"), True)
        return self.sweep(table, buffer_s)

    def sweep(self, table: str, buffer_s: float = 300) -> int:
        used: set[str] = set()
        for status in self._fs.listStatus(self._path(f"{table}/refs")):
            used |= {p.split("/", 1)[0] for p in (self.pointer(table, status.getPath().getName()) or {"paths": []})["paths"]}
        removed = 0
        for status in self._fs.listStatus(self._path(f"{table}/data")):
            if status.getPath().getName() not in used and status.getModificationTime() / 1000 <= time.time() - buffer_s:
                removed += bool(self._fs.delete(status.getPath(), True))
        return removed
