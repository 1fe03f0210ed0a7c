"""A database of one table that needs no server and that every JVM of a cluster can read.

The engine runs inside a JVM: what one holds in memory, or has open for writing, no other sees.  So the tasks write the
rows as text into the shared folder, the driver's engine imports them file by file into a database there, and the closed
database is packed into an archive, which any number of JVMs may read at once.  Neither keeps the rows in memory.
"""

from __future__ import annotations

import shutil
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

CLOSED = "08006"


def archived(rows: DataFrame, name: str, types: dict[str, str]) -> str:
    """URL of a read-only database whose table ``name`` holds the rows; ``types`` gives each column's SQL type."""
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "database"))
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() != "file":
        raise ValueError("an embedded database needs spark.checkpoint.dir on a file system that all machines mount")
    folder = Path(place.toUri().getPath())
    fields = [c for pair in ((F.lit(","), _field(rows, c)) for c in types) for c in pair][1:]
    rows.select(F.concat(*fields).alias("value")).write.text(f"file://{folder}/text")
    _load(spark.sparkContext._jvm.java.sql.DriverManager, folder, name, types)
    shutil.rmtree(folder / "text")
    with zipfile.ZipFile(folder / "db.jar", "w", zipfile.ZIP_STORED) as archive:  # stored, as pages are read by position
        for path in sorted(p for p in (folder / "db").rglob("*") if p.suffix != ".lck"):
            archive.write(path, path.relative_to(folder))
    shutil.rmtree(folder / "db")
    return f"jdbc:derby:jar:({folder}/db.jar)db"


def _field(rows: DataFrame, column: str) -> Column:
    """A value as the import reads it: strings in quotation marks, nothing for null."""
    value = F.col(column)
    text = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')) if dict(rows.dtypes)[column] == "string" else value.cast("string")
    return F.coalesce(text, F.lit(""))


def _load(manager, folder: Path, name: str, types: dict[str, str]) -> None:
    url = f"jdbc:derby:{folder}/db"
    connection = manager.getConnection(f"{url};create=true")
    try:
        connection.createStatement().execute("call SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.storage.pageReservedSpace', '0')")
        columns = ", ".join(f'"{c}" {kind}' for c, kind in types.items())
        connection.createStatement().execute(f"create table {name} ({columns})")
        call = connection.prepareCall("call SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, ?, ?, ',', '\"', 'UTF-8', 0)")
        for path in sorted((folder / "text").glob("part-*")):
            call.setString(1, name.upper())
            call.setString(2, str(path))
            call.execute()
    finally:
        connection.close()
        try:
            manager.getConnection(f"{url};shutdown=true")
        except Py4JJavaError as e:  # the engine tells by an exception that it has closed
            if e.java_exception.getSQLState() != CLOSED:
                raise
