import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import enrich
from tidemill.operators import lineage as ln
from tidemill.session import scratch
from tidemill.sources import generator, names, readers
from tidemill.streaming import pipeline as sp


def test_names(spark):
    assert names.sanitize("﻿注文（ＩＤ）・番号") == "注文_ID_番号" and names.sanitize("a - b/c") == "a_b_c" and names.sanitize("x", {"x": "y"}, {"y": "z"}) == "z"
    df = spark.createDataFrame([(1, 2)], ["a-b", "a b"])
    with pytest.raises(ValueError):
        names.sanitized(df)
    rules = [("^fee.*", "fee", 1), (".*", "rest", 2)]
    assert names.alias_renamed(spark.createDataFrame([(1, 2, 3)], ["FEE_rate", "fee_x", "q"]), rules).columns == ["fee", "fee_x", "rest"]
    got = names.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double"), ["x"]).collect()
    assert [r["x"] for r in got] == [None, 1.0, None]


def test_jdbc_options():
    options = readers.jdbc_options("select 1;", "k", "2024-01-01", "2025-01-01", "jdbc:x")
    assert options["dbtable"] == "(select 1) AS pushed" and options["numPartitions"] == "4" and options["fetchsize"] == "1000"
    for bad in (None, 3, "  "):
        with pytest.raises(ValueError):
            readers.jdbc_options(bad, "k", "0", "1", "u")
    with pytest.raises(ValueError):
        readers.jdbc_options("q", "k", "0", "1", "u", fetch=0)


def test_pushed_day_filter(spark, tmp_path):
    spark.sql("select timestamp_ntz'2025-01-02 10:00:00' t, 1 k").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x")).filter(readers.day_predicate("t", "2025-01-02"))
    assert df.count() == 1 and "GreaterThanOrEqual(t" in ln.plan_text(df)
    assert spark.range(2).filter(readers.day_predicate("id", None)).count() == 2


def test_text_readers(spark, tmp_path):
    (tmp_path / "z_v1.csv").write_text("zip,n\n0012345,x\n", encoding="utf-8")
    rows = readers.versioned_csv(spark, str(tmp_path), "z", "v1")
    assert rows.first()["zip"] == "0012345"
    assert readers.typed(rows, {"n": "int"}).first()["n"] is None
    with pytest.raises(ValueError):
        readers.versioned_csv(spark, str(tmp_path), "z", "v9")
    docs = spark.createDataFrame([(1, "a\nb\n1\n2\nc\n3"), (2, None), (3, "")], "id int, t string")
    assert sorted(map(tuple, readers.paired_lines(docs, "id", "t").collect())) == [(1, "a", "1"), (1, "b", "2"), (1, "c", "3")]
    (tmp_path / "o-v1.json").write_text(spark.range(1).schema.json())
    assert readers.schema_versions(str(tmp_path), "o", (1,))[0][1].names == ["id"]


def test_generator_plants_every_defect(spark):
    rows = generator.orders(spark, 200)
    assert {r["defect"] for r in rows.collect()} == {None, *generator.DEFECTS.values()}
    assert rows.filter("defect = 'nan_tax' and isnan(tax_usd)").count() == 2 and generator.as_messages(rows).count() == 200


def test_what_a_producer_refuses(spark):
    rows = [("0b4f88f9-6cee-44e9-936f-4aaa18bbbdba", 1), ("0B4F88F9-6CEE-44E9-936F-4AAA18BBBDBA", 0), ("0b4f88f9-6cee-14e9-936f-4aaa18bbbdba", 1), (None, 0), ("0b4f88f9-6cee-44e9-936f-4aaa18bbbdba", None)]
    good, bad = generator.validated(spark.createDataFrame(rows, "id string, n int"), "id", "n")
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["identifier", "identifier", "quantity", "quantity"]


def test_sinks_of_the_generator(spark, tmp_path):
    rows = generator.orders(spark, 50)
    generator.write_csv(rows, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c")).count() == 50
    url = "jdbc:derby:memory:gen;create=true"
    generator.write_jdbc(rows.withColumn("tax_usd", F.nanvl("tax_usd", F.lit(0.0))), url, "orders")
    options = readers.jdbc_options('select "user_id", "order_id" from orders', '"user_id"', "1", "100", url, partitions=3)
    got = readers.jdbc(spark, options)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 50
    assert generator.order_stream(spark).isStreaming


def test_rate_limit_and_dead_letters(spark):
    assert enrich.worker_rate(50, 4) == 6 and enrich.worker_rate(50, 100) == 1 and enrich.worker_rate(1000, 1) == 10
    now, slept = [0.0], []
    bucket = enrich.Bucket(2, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(5):
        bucket.take()
    assert slept == [1.0, 1.0]

    def client(rows):
        if any(r["k"] == 3 for r in rows):
            raise enrich.Busy(0.0)
        return {r["k"]: {"v": r["k"] * 2} for r in rows if r["k"] != 1}

    out = enrich.api_enrich(spark.range(6).toDF("k").coalesce(1), "k", client, "k bigint, v int, _dlq boolean", chunk=2, rate=1000, dead={"v": -1})
    assert sorted(map(tuple, out.collect())) == [(0, 0, False), (1, -1, True), (2, -1, True), (3, -1, True), (4, 8, False), (5, 10, False)]


def test_calls_are_counted_and_failures_waited_for(spark):
    counts = enrich.Counts(spark)

    def client(rows):
        if any(r["k"] >= 4 for r in rows):
            raise RuntimeError("down")
        return {r["k"]: {"v": 1} for r in rows}

    enrich.api_enrich(spark.range(6).toDF("k").coalesce(1), "k", client, "k bigint, v int, _dlq boolean", chunk=2, rate=1000, max_attempts=3, counts=counts, wait=0.0).collect()
    assert counts.values() == {"calls": 5, "success": 4, "fail": 2}
    assert [enrich.backoff(n, 0.5, 3.0) for n in range(4)] == [0.5, 1.0, 2.0, 3.0]


def stream_of(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"s/p={i}"))
    return sp.files(spark, str(tmp_path / "s/*"), spark.createDataFrame([], schema).schema, max_files=1)


def test_dedup_across_batches_and_lateness(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    parts = [[(1, t), (1, t)], [(1, t), (2, t + dt.timedelta(hours=2))], [(3, t + dt.timedelta(hours=2))], [(9, t - dt.timedelta(days=1))]]
    stream = stream_of(spark, tmp_path, parts, "id int, ts timestamp")
    assert sorted(r["id"] for r in sp.collected(sp.deduplicated(stream, ["id"], "ts")).collect()) == [1, 2, 3]


def test_parse_and_decode(spark, tmp_path):
    texts = [('{"id": 1, "at": "2025-01-01 00:00:00"}',), ('{"id": 2, "at": "2025-01-01 00:00:00+09"}',), ("{bad",)]
    stream = stream_of(spark, tmp_path, [texts], "value string")
    got = sp.collected(sp.parsed(stream, "value", "id int, at string", "at").drop("processing_time")).collect()
    assert sorted((r["id"] or 0, r["at"] is not None) for r in got) == [(0, False), (1, True), (2, False)]
    good, dead = sp.versioned_decode(spark.createDataFrame(texts, "value string"), "value", [(2, "key int"), (1, "id int, at string")], "id", {2: "key"})
    assert [r["schema_version"] for r in good.collect()] == [1, 1] and [r["value"] for r in dead.collect()] == ["{bad"]


def test_sink_errors_are_raised(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1,)]], "id int")

    def broken(batch, number):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        sp.run_to_end(stream, sp.guarded(broken))


def test_jobs_context_and_lineage(spark, tmp_path):
    order = []
    jobs = {"c": ln.Job(lambda _: order.append("c"), ("a", "b")), "a": ln.Job(lambda _: order.append("a")), "b": ln.Job(lambda _: order.append("b"), ("a",), True)}
    assert ln.run_jobs(jobs, ln.RunContext()) == ["a", "b", "c"] and order == ["a", "c"]
    with pytest.raises(ValueError):
        ln.run_jobs({"x": ln.Job(print, ("y",)), "y": ln.Job(print, ("x",))}, ln.RunContext())
    context = ln.RunContext(env="dev", mode="BRANCH", tables={"o": "c.n.o"})
    assert context.table("o") == "c.n.o.branch_dev" and ln.RunContext("2025-01-01").day() == "2025-01-01"
    assert ln.RunContext().day(events=[dt.datetime(2025, 2, 2, 3)]) == "2025-02-02"
    with pytest.raises(AttributeError):
        context.table("x")
    path = str(tmp_path / "t")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    df = spark.read.parquet(path)
    assert ln.require_partition_filter(df.filter("p = 1"), "p").count() == 2
    with pytest.raises(ValueError):
        ln.require_partition_filter(df.filter("id = 1"), "p")
    assert json.loads(ln.lineage_event("j", df, "out", ln.RunContext()))["output"] == "out" and ln.lineage_event("j", df, "o", context) is None
    failed = ln.run_ddl(spark, ["create namespace if not exists n_x", "create nonsense", "drop namespace n_x"])
    assert len(failed) == 1
    ln.create_namespaces(spark, ["n_y"])
    with pytest.raises(ValueError):
        ln.create_namespaces(spark, ["bad name"])


def test_tables_with_properties(spark):
    made = ln.table_ddl("t_props", "k bigint, d date", ["d"], {"team": "desk's"}, "orders by day", ["k"])
    assert ln.run_ddl(spark, made) == []
    told = {r["key"]: r["value"] for r in spark.sql("show tblproperties t_props").collect()}
    assert told["team"] == "desk's" and told["identifier.fields"] == "k"
    assert spark.catalog.listColumns("t_props")[1].isPartition
    spark.sql("drop table t_props")


def test_console_of_good_and_dead_rows(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[("a",), (None,)]], "v string")
    running = [sp.console(stream.filter(f"v is {kind} null"), name, scratch(spark, name)) for kind, name in (("not", "good"), ("", "dead"))]
    for one in running:
        one.processAllAvailable()
        assert one.name in ("good", "dead") and one.exception() is None
        one.stop()


def test_sharing_of_a_batch(spark, tmp_path):
    seen = []
    stream = stream_of(spark, tmp_path, [[(1,), (2,)]], "id int")
    sp.run_to_end(stream, sp.tee([lambda b, n: seen.append(b.count()), lambda b, n: seen.append(-b.count())]))
    assert seen == [2, -2] and scratch(spark, "x") != scratch(spark, "x")
