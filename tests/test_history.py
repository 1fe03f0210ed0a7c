import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemill.functions.text import fold_width, folded
from tidemill.operators.history import versions

SNAP = "load_seq bigint, fund_id string, cat string, fee decimal(5,2), live boolean, day date, extra string"
DIM = "fund_id string, cat string, fee decimal(5,2), live boolean, s date, e date, cur boolean"
D = lambda m, y=2023: dt.date(y, m, 28)
OPEN = dt.date(9999, 12, 31)


def run(spark, snaps, dims):
    attributes = {"cat": folded(F.col("cat")), "fee": F.col("fee"), "live": F.col("live")}
    out = versions(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(dims, DIM), "fund_id", "day", "load_seq", attributes, "s", "e", "cur")
    return sorted((r["fund_id"], r["effective_start_date"], r["effective_end_date"], r["cat"], r["is_current"]) for r in out.collect())


def test_changes_nulls_and_absence(spark):
    x = Decimal("1.00")
    snaps = [
        (2, "A", "BOND ", x, True, D(1), "z"), (1, "A", "REIT", x, True, D(1), "z"),  # the greater load_seq holds
        (3, "A", "ｂｏｎｄ", x, True, D(2), None),  # only width and case differ
        (5, "A", None, x, True, D(4), None), (6, "A", None, x, True, D(5), None),  # null is a value; March is absent
        (7, "A", "BOND", x, None, D(6), None), (7, "A", "BOND", x, None, D(6), None),
        (8, None, "BOND", x, True, D(6), None), (9, "B", "BOND", x, True, None, None),
    ]
    dims = [("A", "REIT", x, True, D(1, 2020), D(2, 2020), False), ("A", "bond", x, True, D(2, 2020), OPEN, True), ("A", "bond", x, True, D(2, 2020), OPEN, True)]
    assert run(spark, snaps, dims) == [
        ("A", D(1, 2020), D(2, 2020), "REIT", False), ("A", D(2, 2020), D(4), "bond", False), ("A", D(4), D(6), None, False), ("A", D(6), OPEN, "BOND", True),
    ]


def test_new_entity_starts_at_its_first_snapshot(spark):
    assert [r[:3] for r in run(spark, [(1, "N", "X", None, None, D(3), None)], [])] == [("N", D(3), OPEN)]


def test_empty(spark):
    assert run(spark, [], []) == []


def test_width(spark):
    got = spark.createDataFrame([("ｲﾝﾃﾞｯｸｽ　ＡＢ",), (None,)], "t string").select(fold_width(F.col("t")).alias("x"), folded(F.col("t")).alias("y")).collect()
    assert got[0]["x"] == "インデックス AB" and got[0]["y"] == "インデックス ab" and got[1]["x"] is None
