"""Session factory and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "tidemill", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings every operator is tested under."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus or os.cpu_count() or 1}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where the setting is missing in local mode (tests, a
    laptop) a temporary folder is made once and set as the checkpoint folder of this session; elsewhere it is an error,
    as other machines could not read such a folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df, purpose: str, partition_by: list[str] | None = None):
    """Write a result once into the shared folder and read it back, so that later jobs do not repeat its lineage."""
    path = scratch(df.sparkSession, purpose)
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df) -> None:
    """Remove the folder of a materialized frame that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
