"""Scans: delimited files, JDBC, JSON text, versioned binary messages, line-paired documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True, infer: bool = False) -> DataFrame:
    """Delimited files with a schema (kept as written: zip codes stay strings), or inferred types, or all strings."""
    reader = spark.read.option("header", header).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def versioned_csv(spark: SparkSession, root: str, name: str, version: str, **options) -> DataFrame:
    """``<root>/<name>_<version>.csv``."""
    if version not in ("v1", "v2"):
        raise ValueError(f"unknown version {version!r}")
    return csv(spark, f"{root}/{name}_{version}.csv", **options)


def typed(df: DataFrame, kinds: dict[str, str], partition: tuple[str, str] | None = None) -> DataFrame:
    """Casts of an all-string scan (null where a value does not fit), and a partition date derived from a column."""
    out = df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})
    return out.withColumn(partition[0], F.to_date(partition[1])) if partition else out


def jdbc_options(
    query: str, column: str, lower: str, upper: str, url: str, partitions: int = 4, fetch: int = 1000, least: int = 1, most: int = 10_000
) -> dict[str, str]:
    """Options of a partitioned scan of a pushed-down subquery.  Bounds set strides only, they do not filter."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query must be a non-blank string")
    if not least <= fetch <= most:
        raise ValueError(f"fetch size must be from {least} to {most}")
    if partitions < 1:
        raise ValueError("there must be a partition")
    return {
        "url": url, "dbtable": f"({query.strip().rstrip(';')}) AS pushed", "partitionColumn": column, "lowerBound": lower, "upperBound": upper,
        "numPartitions": str(partitions), "fetchsize": str(fetch),
    }


def jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def day_predicate(column: str, day: str | None) -> Column:
    """Extraction predicate of one logical date, or of everything without one.

    Written as a range on the raw column so that it reaches the scan as a pushed filter.
    """
    if day is None:
        return F.lit(True)
    start = F.lit(day).cast("date")
    return (F.col(column) >= start.cast("timestamp_ntz")) & (F.col(column) < F.date_add(start, 1).cast("timestamp_ntz"))


def json_rows(lines: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    """Columns of JSON text by a declared schema (no inference pass over the data)."""
    return lines.select(F.from_json(column, schema).alias("_row")).select("_row.*")


def json_text(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


WIRE_HEADER = 5


def wire_payload(value: Column) -> Column:
    """A message without its header of one magic byte and a four-byte schema id."""
    return F.substring(value, WIRE_HEADER + 1, 2**31 - 1 - WIRE_HEADER)


def schema_versions(folder: str, subject: str, versions: tuple[int, ...] = (2, 1)) -> list[tuple[int, StructType]]:
    """Local stand-in for a schema registry: ``<folder>/<subject>-v<n>.json`` holds a Spark schema, newest first."""
    return [(v, StructType.fromJson(json.loads(Path(folder, f"{subject}-v{v}.json").read_text()))) for v in versions]


def paired_lines(docs: DataFrame, key: str, text: str, pairs: tuple[tuple[int, int], ...] = ((0, 2), (1, 3), (4, 5))) -> DataFrame:
    """Header and value lines of a document's text as rows (key, header, value): line i of each pair names line j."""
    lines = F.split(F.col(text), "\n")
    rows = F.array(*(F.struct(F.trim(F.get(lines, F.lit(i))).alias("header"), F.trim(F.get(lines, F.lit(j))).alias("value")) for i, j in pairs))
    return docs.select(key, F.inline(rows)).filter("header is not null and header <> ''")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str | DataType) -> DataFrame:
    return spark.createDataFrame(rows, schema)
