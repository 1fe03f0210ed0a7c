import datetime as dt
import random

import numpy as np

from tidemill.operators.rolling import LEAST, MOST, SUM, rolling_totals, trailing


def test_queue_against_brute_force():
    values = np.random.default_rng(0).integers(-50, 50, (5, 40))
    for monoid, plain in ((SUM, np.sum), (LEAST, np.min), (MOST, np.max)):
        for w in (1, 3, 7, 60):
            want = [[plain(row[max(0, d - w + 1) : d + 1]) for d in range(40)] for row in values]
            assert (trailing(values, w, monoid) == np.array(want)).all()


def brute(rows, last, w):
    out = {}
    for user in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == user and r[1] and r[1] <= last]
        if not mine:
            continue
        day = min(r[1] for r in mine)
        while day <= last:
            c = [r[2] for r in mine if r[2] is not None and day - dt.timedelta(days=w) < r[1] <= day]
            out[user, day] = (sum(c) / 100, sum(c) / 100 / len(c) if c else None, min(c) / 100 if c else None, max(c) / 100 if c else None, len(c))
            day += dt.timedelta(days=1)
    return out


def test_totals_against_brute_force(spark):
    rng = random.Random(2)
    start = dt.date(2025, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None] + [start + dt.timedelta(days=rng.randint(0, 50))] * 9), rng.choice([None, 5, 120, -30])) for _ in range(200)]
    last = start + dt.timedelta(days=55)
    df = spark.createDataFrame(rows, "u int, d date, c bigint")
    got = rolling_totals(df, "u", "d", "c", spark.createDataFrame([(last,)], "x date"))
    table = {(r["u"], r["d"]): r for r in got.collect()}
    for w in (7, 30):
        want = brute(rows, last, w)
        assert table.keys() == want.keys()
        for k, v in want.items():
            assert (table[k][f"sum_{w}"], table[k][f"avg_{w}"], table[k][f"min_{w}"], table[k][f"max_{w}"], table[k][f"orders_{w}"]) == v


def test_silence_ends_a_calendar_and_loses_no_order(spark, monkeypatch):
    import tidemill.operators.rolling as module

    start, last = dt.date(2025, 1, 1), dt.date(2025, 6, 1)
    rows = [(1, dt.date(2000, 1, 1), 7), (1, start, 5), (1, dt.date(2025, 5, 30), None), (2, dt.date(2000, 1, 1), 9), (3, start, 4), (3, start + dt.timedelta(days=40), 6), (4, dt.date(1970, 1, 1), 1)]
    df = spark.createDataFrame(rows, "u int, d date, c bigint")
    want = {}
    for u, d, c in rows:
        until = min([x[1] for x in rows if x[0] == u and x[1] > d] + [last + dt.timedelta(days=1), d + dt.timedelta(days=41)])
        want |= {(u, d + dt.timedelta(days=n)): 1 for n in range((until - d).days)}
    for cells in (1 << 19, 50):
        monkeypatch.setattr(module, "CELLS", cells)
        got = rolling_totals(df, "u", "d", "c", spark.createDataFrame([(last,)], "x date"), idle=40).collect()
        assert sorted((r["u"], r["d"]) for r in got) == sorted(want)
        assert sum(r["orders_7"] for r in got) == 7 * 6 and {(r["u"], r["d"]): r["sum_30"] for r in got}[3, start + dt.timedelta(days=40)] == 0.06


def test_empty(spark):
    df = spark.createDataFrame([], "u int, d date, c bigint")
    assert rolling_totals(df, "u", "d", "c", spark.createDataFrame([(None,)], "x date")).count() == 0
