import datetime as dt
import json

import pytest

from tidemill.operators.ingest import Extractor, add_partitions, documents, export_documents, ingest
from tidemill.session import scratch
from tidemill.sources.store import TableStore

T = dt.datetime(2025, 1, 2, 10)
ROWS = "`user-id` int, x double, at timestamp_ntz"


def test_ingest_of_a_day(spark):
    source = spark.createDataFrame([(1, float("nan"), T), (None, 2.0, T), (3, 1.0, T - dt.timedelta(days=1))], ROWS)
    out = ingest(source, "2025-01-03", "user_id", "at", "2025-01-02", None, ("x",)).orderBy("user_id").collect()
    assert [(r["user_id"], r["x"], r["user_id_hash"] is None) for r in out] == [(None, 2.0, True), (1, None, False)]
    assert {r["ingest_date"] for r in out} == {dt.date(2025, 1, 3)}
    assert ingest(source, "2025-01-03", "user_id").count() == 3


def test_extractor_is_idempotent(spark):
    source = spark.createDataFrame([(1, 1.0, T)], ROWS)
    store = TableStore(spark, scratch(spark, "store"))
    one = Extractor(lambda s: ingest(source, "2025-01-03", "user_id"), "t")
    assert one.run(spark, store) == one.run(spark, store) == 1
    assert Extractor(lambda s: ingest(source, "2025-01-04", "user_id"), "t").run(spark, store) == 2
    with pytest.raises(ValueError):
        Extractor(lambda s: source, "t").run(spark, store)


def test_external_partitions_and_documents(spark):
    df = spark.createDataFrame([(1, "2025-01-01"), (2, "2025-01-02"), (3, None)], "k int, d string")
    where = scratch(spark, "external")
    assert add_partitions(df, "t_external", where, "d") == ["2025-01-01", "2025-01-02", "__HIVE_DEFAULT_PARTITION__"]
    assert add_partitions(df.filter("k = 1"), "t_external", where, "d", files=1) is not None and spark.table("t_external").count() == 3
    spark.sql("drop table t_external")
    assert json.loads(documents(df.filter("k = 3"), ["k", "d"]).first()["value"]) == {"_id": "3", "k": 3}
    path = scratch(spark, "documents")
    export_documents(df.union(df), ["k"], path)
    export_documents(df.union(df), ["k"], path)
    assert sorted(json.loads(r["value"])["_id"] for r in spark.read.text(path).collect()) == ["1", "2", "3"]
