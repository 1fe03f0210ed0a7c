import datetime as dt

from pyspark.sql import functions as F

from tidemill.operators import modeling as m
from tidemill.operators.cdc import append_changes, cdc_log, replayed

OPEN = dt.date(9999, 12, 31)
DIM = "k string, c string, effective_start_date date, effective_end_date date, is_current boolean"


def test_scd2(spark):
    start, day = dt.date(2024, 1, 1), dt.date(2025, 1, 1)
    current = spark.createDataFrame([("a", "x", start, OPEN, True), ("b", "x", start, OPEN, True), ("n", None, start, OPEN, True), ("g", "x", start, OPEN, True), ("a", "w", dt.date(2023, 1, 1), start, False)], DIM)
    source = spark.createDataFrame([("a", "y"), ("b", "x"), ("n", "z"), ("new", None), (None, "q"), ("a", "y")], "k string, c string")
    got = lambda **o: sorted((r["k"], r["c"] or "-", r["effective_start_date"], r["effective_end_date"], r["is_current"]) for r in m.scd2_apply(current, source, "k", ["c"], "2025-01-01", **o).collect())
    plain = got()
    assert plain == [
        ("a", "w", dt.date(2023, 1, 1), start, False), ("a", "x", start, day, False), ("a", "y", day, OPEN, True), ("b", "x", start, OPEN, True), ("g", "x", start, OPEN, True),
        ("n", "-", start, OPEN, True), ("new", "-", day, OPEN, True),
    ]
    safe = got(null_safe=True, close_missing=True)
    assert ("n", "z", day, OPEN, True) in safe and ("g", "x", start, day, False) in safe
    again = m.scd2_apply(m.scd2_apply(current, source, "k", ["c"], "2025-01-01"), source, "k", ["c"], "2025-02-01")
    assert again.count() == len(plain)
    assert m.overlap_flags(again, "k").filter("not no_overlap").count() == 0


def test_incremental_fact_falls_back_to_the_stored_price(spark):
    d = lambda n: dt.date(2025, 1, n)
    stored = spark.createDataFrame([("A", d(1), 10.0), ("A", d(2), 12.0), ("B", d(1), 5.0)], "f string, d date, p double")
    delta = spark.createDataFrame([("A", d(2), 12.0), ("A", d(3), 15.0), ("A", d(4), 15.0), ("B", d(2), 6.0), ("B", d(3), 7.0), ("C", d(3), 1.0)], "f string, d date, p double")
    got = {(r["f"], r["d"].day): (r["previous"], r["change"]) for r in m.incremental_fact(delta, stored, "f", "d", "p").collect()}
    assert got == {("A", 3): (12.0, 3.0), ("A", 4): (15.0, 0.0), ("B", 3): (5.0, 2.0), ("C", 3): (None, 0.0)}
    per_key = {(r["f"], r["d"].day) for r in m.incremental_fact(delta, stored, "f", "d", "p", per_key_watermark=True).collect()}
    assert ("B", 2) in per_key
    assert m.incremental_fact(delta, stored.limit(0), "f", "d", "p").count() == 6


CUSTOMERS = "user_id int, address string, channel string"


def test_change_log_golden(spark):
    old = spark.createDataFrame([(1, "x", "web"), (2, "x", "web"), (3, "x", "web"), (5, "x", "web")], CUSTOMERS)
    new = spark.createDataFrame([(1, "x", "web"), (2, "y", "web"), (3, "x", "app"), (4, "x", "web")], CUSTOMERS)
    log = cdc_log(old, new, "user_id", ["address", "channel"])
    assert sorted((r["user_id"], r["version"], r["op"], r["is_current"]) for r in log.collect()) == [
        (1, 1, "I", True), (2, 1, "I", False), (2, 2, "U", True), (3, 1, "I", False), (3, 2, "U", True), (4, 1, "I", True), (5, 1, "I", False), (5, 2, "D", True),
    ]
    assert sorted(map(tuple, replayed(log, "user_id", ["address", "channel"]).collect())) == sorted(map(tuple, new.collect()))
    third = new.filter("user_id <> 1").unionByName(spark.createDataFrame([(5, "back", "web")], CUSTOMERS))
    longer = append_changes(log, third, "user_id", ["address", "channel"])
    assert sorted(map(tuple, replayed(longer, "user_id", ["address", "channel"]).collect())) == sorted(map(tuple, third.collect()))
    assert {(r["version"], r["op"]) for r in longer.filter("user_id = 5").collect()} == {(1, "I"), (2, "D"), (3, "I")}
    assert longer.filter("is_current").groupBy("user_id").count().filter("count > 1").count() == 0


def test_null_to_value_is_a_change(spark):
    old, new = spark.createDataFrame([(1, None, "a")], CUSTOMERS), spark.createDataFrame([(1, "", "a")], CUSTOMERS)
    assert cdc_log(old, new, "user_id", ["address", "channel"]).filter("op = 'U'").count() == 1


def test_wide_reconcile_pivot_and_calendar(spark):
    fact = spark.createDataFrame([(1, 10), (2, 99)], "o int, u int")
    dim = spark.createDataFrame([(10, "n")], "u int, name string")
    assert sorted((r["o"], r["name"]) for r in m.wide(fact, [(dim, [("u", "u")])]).collect()) == [(1, "n"), (2, None)]
    assert m.reconcile(fact, fact).count() == 0 and m.reconcile(fact, fact.union(fact)).count() == 2
    long = spark.createDataFrame([("01-01", "A", 100), ("01-01", "B", 200), ("01-02", "A", 150), ("01-02", "B", 250)], "d string, c string, v int")
    assert sorted(map(tuple, m.pivot_sum(long, "d", "c", "v").collect())) == [("01-01", 100, 200), ("01-02", 150, 250)]
    row = spark.range(1).select(*(c.alias(n) for n, c in m.calendar(F.lit("2025-03-30").cast("date")).items())).first()
    assert (row["weekday"], row["fiscal_year"], row["date_key"], row["is_month_end"]) == (1, 2024, 20250330, False)


def test_surrogate_key_value(spark):
    assert spark.range(1).select(m.surrogate(F.lit("1"))).first()[0] == -928762887014768240
