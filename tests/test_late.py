import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators.late import PeriodTotals, judge, replay
from tidemill.session import scratch

SCHEMA = "n bigint, created_at timestamp_ntz, ingest_ts timestamp_ntz, cents bigint, kept boolean"
T = dt.datetime(2025, 3, 1)


def brute(rows):
    """(late ids, totals per hour) straight from the definition."""
    late, totals = set(), {}
    batches = sorted({r[2] for r in rows if r[2]})
    top, before = None, {}
    for b in batches:
        before[b] = top
        tops = [r[1] for r in rows if r[2] == b and r[1] and r[1] <= b]
        top = max([t for t in [top, *tops] if t], default=None)
    for n, c, i, cents, kept in rows:
        if not kept or not c or not i or c > i:
            continue
        hour = c.replace(minute=0, second=0, microsecond=0)
        if before[i] and hour + dt.timedelta(hours=1) <= before[i] - dt.timedelta(hours=2):
            late.add(n)
        else:
            k, s = totals.get(hour, (0, 0))
            totals[hour] = (k + 1, s + (cents or 0))
    return late, totals


def sample(seed, size=150):
    rng, rows = random.Random(seed), []
    for n in range(size):
        at = T + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 12))
        lag = rng.choice([1, 5, 30, 60 * 3, 60 * 24 * 4])
        created = rng.choice([at] * 8 + [None, at + dt.timedelta(days=400), T - dt.timedelta(days=9000)])
        rows.append((n, created, None if rng.random() < 0.02 else at + dt.timedelta(minutes=lag - lag % 5), rng.choice([None, 100, 250]), rng.random() > 0.1))
    return rows


@pytest.mark.parametrize("live", [0, 2, 5])
def test_replay_matches_brute_force(spark, live):
    rows = sample(3)
    df = spark.createDataFrame(rows, SCHEMA)
    store = replay(PeriodTotals(spark, scratch(spark, "late")), df, live)
    late, totals = brute(rows)
    assert {r["n"] for r in store.retained().filter("status = 'late'").collect()} == late and late
    assert {r["hour"]: (r["orders"], r["cents"] or 0) for r in store.totals().collect()} == totals
    assert store.retained().count() == len(rows)
    assert {r["n"] for r in judge(df, "created_at", "ingest_ts").filter("status = 'late'").collect()} == late


def test_a_batch_applied_twice_changes_nothing(spark):
    df = spark.createDataFrame(sample(4, 40), SCHEMA).filter("ingest_ts is not null")
    store = PeriodTotals(spark, scratch(spark, "late"))
    store.apply(df, "one")
    first = sorted(map(tuple, store.totals().collect()))
    store.apply(df, "one")
    assert sorted(map(tuple, store.totals().collect())) == first


def test_many_batches_are_compacted_and_stay_right(spark, monkeypatch):
    import tidemill.operators.late as module

    monkeypatch.setattr(module, "COMPACT_AT", 4)
    rows = sample(5, 120)
    store = replay(PeriodTotals(spark, scratch(spark, "late")), spark.createDataFrame(rows, SCHEMA), 9)
    late, totals = brute(rows)
    assert len(store.manifest()["batches"]) == 10 and len(store.manifest()["stored"]) < 4
    assert {r["n"] for r in store.retained().filter("status = 'late'").collect()} == late
    assert {r["hour"]: (r["orders"], r["cents"] or 0) for r in store.totals().collect()} == totals and store.retained().count() == len(rows)


def test_empty_table_and_nulls_only(spark):
    empty = spark.createDataFrame([], SCHEMA)
    store = replay(PeriodTotals(spark, scratch(spark, "late")), empty)
    assert store.totals().count() == 0 and store.retained().count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, True)], SCHEMA)
    store = replay(PeriodTotals(spark, scratch(spark, "late")), nulls.withColumn("status", F.lit("x")).withColumn("seen_before", F.lit(1)))
    assert [r["status"] for r in store.retained().collect()] == ["unusable"]
