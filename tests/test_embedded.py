"""The scan of a database, beside SQL: rows that are hard to carry, and executors that are other processes than the driver."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

import __spark_entry__ as entry
from tidemill.sources import embedded

SCHEMA = "c_custkey bigint, c_acctbal double, c_mktsegment string"
TEXTS = ["plain", "", None, 'q"u"o', '"', "c,d", " lead", "trail ", "n\nl", "r\r\nl", "b\\s", "日本", "'", "x" * 40]
ROWS = [(10 * i - 5, 1.5, text) for i, text in enumerate(TEXTS * 2)] + [
    (None, 2.0, "no key"), (1, None, "no balance"), (2, 0.0, "zero"), (3, -1.0, "debt"), (10**12, 1e300, "beyond the bounds"),
    (4, float("nan"), "no number"), (5, float("inf"), "no number"), (6, float("-inf"), "debt"), (None, None, None),
]


def beside_sql(spark, folder):
    from compare import connect, normal

    got = entry.queries()["jdbc_partitioned_scan"](spark, folder).toPandas()
    return normal(got), normal(connect(folder).sql(entry.oracle_sql()["jdbc_partitioned_scan"]).df())


@pytest.mark.parametrize("rows", [ROWS, []])
def test_scan_of_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    got, want = beside_sql(spark, str(tmp_path))
    assert got == want and len(got) == (len(TEXTS) + 3 if rows else 0)


def test_the_folder_must_be_mounted(spark, monkeypatch):
    monkeypatch.setattr(embedded, "scratch", lambda *_: "http://elsewhere/shared")
    with pytest.raises(ValueError, match="mount"):
        embedded.archived(spark.range(1), "t", {"id": "bigint"})


CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
from test_embedded import beside_sql
folder, shared = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.checkpoint.dir": "file://" + shared, "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
try:
    print(json.dumps(beside_sql(spark, folder)))
finally:
    spark.stop()
"""


def test_scan_where_executors_are_other_processes(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/t/customer.parquet")
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # where executors write their logs
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    root = Path(entry.__file__).parent
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": f"{root}:{root}/tests", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", CLUSTER, f"{tmp_path}/t", f"{tmp_path}/shared"], cwd=tmp_path, env=env, check=True, stdout=subprocess.PIPE, text=True, timeout=300)
    got, want = json.loads(done.stdout.splitlines()[-1])
    assert got == want and len(got) == len(TEXTS) + 3
