import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.session import scratch
from tidemill.sources import store as module
from tidemill.sources.store import Conflict, TableStore, branch_name


@pytest.fixture
def store(spark):
    return TableStore(spark, scratch(spark, "store"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_names_of_tables():
    assert branch_name("c.n.t", "BRANCH", "dev") == "c.n.t.branch_dev"
    assert branch_name("c.n.t", "ZERO_COPY", "dev") == "dev_c.n_dev.t.branch_dev"
    assert branch_name("n.t", "ZERO_COPY", "dev") == "n.t" and branch_name("c.n.t", "BRANCH", "main") == "c.n.t"
    assert branch_name("c.n.t", "ZERO_COPY", "main") == "dev_c.n_main.t.branch_main" and branch_name("c.n.t.x", "ZERO_COPY", "dev") == "dev_c.n_dev.t.x.branch_dev"
    assert branch_name("c.n.t", None, "dev") == "c.n.t" and branch_name("c.n.t", "BRANCH", None) == "c.n.t"


def test_overwrite_reads_what_it_replaces(spark, store):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, p string")
    store.create(df, "t", ["p"])
    store.overwrite_partitions(store.read("t").filter("p = 'b' and k = 2"), "t", require="p")
    store.overwrite_partitions(spark.createDataFrame([(9, "c")], "k int, p string"), "t")
    assert rows(store.read("t")) == [(1, "a"), (2, "b"), (9, "c")]
    with pytest.raises(ValueError):
        store.overwrite_partitions(df.select("k"), "t", require="p")
    store.overwrite_partitions(spark.createDataFrame([(1, None), (2, None)], "k int, p string"), "t")
    store.overwrite_partitions(spark.createDataFrame([(3, None)], "k int, p string"), "t")
    assert (3, None) in [tuple(r) for r in store.read("t").collect()] and store.read("t").filter("p is null").count() == 1


def test_unpartitioned_overwrite_replaces_all(spark, store):
    store.create(spark.range(3).toDF("k"), "t")
    store.overwrite_partitions(spark.range(1).toDF("k"), "t")
    assert store.read("t").count() == 1


def test_merge(spark, store):
    store.create(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "t")
    source = spark.createDataFrame([(2, "B"), (3, None)], "k int, v string")
    for _ in range(2):  # twice is the same as once
        store.merge(source, "t", ["k"])
    assert sorted(map(str, rows_any(store))) == sorted(map(str, [(1, "a"), (2, "B"), (3, None)]))
    for bad in ([(2, "x"), (2, "y")], [(None, "x")]):
        with pytest.raises(ValueError):
            store.merge(spark.createDataFrame(bad, "k int, v string"), "t", ["k"])
    store.merge_update(spark.createDataFrame([(1, "q"), (7, "q")], "k int, w string"), "t", ["k"], {"v": F.col("source.w")})
    assert {r["k"]: r["v"] for r in store.read("t").collect()} == {1: "q", 2: "B", 3: None}


def rows_any(store):
    return [tuple(r) for r in store.read("t").collect()]


def test_branches_clones_and_sweep(spark, store):
    store.create(spark.range(4).toDF("k"), "t")
    store.branch("t", "dev")
    assert store.read("t", "dev").count() == 4
    store.append(spark.range(1).toDF("k"), "t", branch="dev")
    assert (store.read("t").count(), store.read("t", "dev").count()) == (4, 5)
    store.clone_empty("t", "dev_t")
    assert store.read("dev_t").count() == 0 and store.read("dev_t").columns == ["k"]
    assert store.teardown("t", "dev", buffer_s=0) == 1 and store.read("t").count() == 4
    with pytest.raises(ValueError):
        store.read("t", "dev")


def test_append_widens(spark, store):
    store.create(spark.range(1).toDF("k"), "t")
    store.append(spark.createDataFrame([(5, "x")], "k bigint, v string"), "t")
    store.append(spark.createDataFrame([("y",)], "v string"), "t")
    assert {(r["k"], r["v"]) for r in store.read("t").collect()} == {(0, None), (5, "x"), (None, "y")}


def test_merge_rewrites_only_touched_partitions(spark, store):
    rows = [(1, "a", dt.date(2025, 1, 1)), (2, "b", dt.date(2025, 1, 2)), (3, "c", None), (4, "d", dt.date(2025, 1, 3))]
    store.create(spark.createDataFrame(rows, "k int, v string, d date"), "t", ["d"])
    before = set(store.pointer("t")["paths"])
    store.merge(spark.createDataFrame([(2, "B", dt.date(2025, 1, 9)), (7, "x", None)], "k int, v string, d date"), "t", ["k"])
    after = set(store.pointer("t")["paths"])
    assert {p.split("/")[1] for p in before & after} == {"d=2025-01-01", "d=2025-01-03"}
    assert {r["k"]: (r["v"], r["d"]) for r in store.read("t").collect()} == {1: ("a", dt.date(2025, 1, 1)), 2: ("B", dt.date(2025, 1, 9)), 3: ("c", None), 4: ("d", dt.date(2025, 1, 3)), 7: ("x", None)}
    store.merge_update(spark.createDataFrame([(4,)], "k int"), "t", ["k"], {"v": F.lit("D")})
    assert len(set(store.pointer("t")["paths"]) & after) == len(after) - 1 and store.read("t").filter("v = 'D'").count() == 1
    with pytest.raises(ValueError):
        store.merge_update(spark.createDataFrame([(4,)], "k int"), "t", ["k"], {"d": F.lit(None)})


def test_readers_between_the_steps_of_a_write_see_the_old_state(spark, store, monkeypatch):
    store.create(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, p string"), "t", ["p"])
    seen, whole = [], TableStore._point

    def watched(self, *args):
        seen.append(rows(self.read("t")))
        whole(self, *args)
        seen.append(rows(self.read("t")))

    monkeypatch.setattr(TableStore, "_point", watched)
    store.overwrite_partitions(spark.createDataFrame([(9, "b")], "k int, p string"), "t")
    assert seen == [[(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (3, "c"), (9, "b")]]  # one move of the pointer


def test_of_two_writers_one_must_begin_anew(spark, store, monkeypatch):
    store.create(spark.range(1).toDF("k"), "t")
    whole = TableStore._data

    def interrupted(self, *args):
        monkeypatch.setattr(TableStore, "_data", whole)
        store.append(spark.range(5, 6).toDF("k"), "t")  # another writer is faster
        return whole(self, *args)

    monkeypatch.setattr(TableStore, "_data", interrupted)
    with pytest.raises(Conflict):
        store.append(spark.range(7, 8).toDF("k"), "t")
    store.append(spark.range(7, 8).toDF("k"), "t")
    assert rows(store.read("t")) == [(0,), (5,), (7,)]


def test_old_versions_of_a_pointer_are_dropped(spark, store, monkeypatch):
    monkeypatch.setattr(module, "KEPT_VERSIONS", 2)
    for n in range(4):
        store.create(spark.range(n).toDF("k"), "t")
    assert len(store._versions("t", "main")) == 2 and store.read("t").count() == 3
