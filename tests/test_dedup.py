import datetime as dt
import random

from tidemill.operators.dedup import BLOCK, KEYS, RANGES, accept, accept_all, mark_duplicates, merge_ranges

UUID = "0b4f88f9-6cee-44e9-936f-4aaa18bbbdba"
SCHEMA = "n bigint, id string, ts timestamp_ntz"
T = dt.datetime(2025, 1, 1)


def kept(df):
    return sorted(r["n"] for r in df.filter("kept").collect())


def test_spellings_of_one_uuid_are_one_message(spark):
    spelled = [UUID, UUID.upper(), UUID.replace("-", ""), "{" + UUID + "}", f"urn:uuid:{UUID}", f" {UUID} ", "０" + UUID[1:], f"URN:UUID:{UUID.upper()}"]
    rows = [(i, s, T) for i, s in enumerate(spelled)]
    assert kept(mark_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "ts", "n")) == [0]


def test_nulls_blanks_and_unknown_forms(spark):
    rows = [(1, None, T), (2, None, T), (3, "", T), (4, "  ", T), (5, "odd!", T), (6, "odd!", T), (7, "odd?", None), (8, "odd?", T), (9, None, None)]
    assert kept(mark_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "ts", "n")) == [1, 2, 3, 4, 5, 8, 9]


def test_earliest_then_smallest_is_kept(spark):
    rows = [(5, UUID, T), (3, UUID, T), (1, UUID, T + dt.timedelta(microseconds=1))]
    assert kept(mark_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "ts", "n")) == [3]


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, UUID, T, "a", 7), (2, UUID, T, "b", 8)], "n bigint, id string, ts timestamp_ntz, _key string, kept int")
    out = mark_duplicates(df, "id", "ts", "n")
    assert out.columns == ["n", "id", "ts", "_key", "kept"] and kept(out) == [1]
    assert mark_duplicates(df.limit(0), "id", "ts", "n").count() == 0


def test_other_types_of_order_and_id(spark):
    df = spark.createDataFrame([("b", UUID, "2"), ("a", UUID, "2"), ("c", UUID, "1")], "n string, id string, ts string")
    assert kept(mark_duplicates(df, "id", "ts", "n")) == ["c"]


def test_hot_message(spark):
    df = spark.range(30_000).selectExpr("id n", f"if(id % 3 = 0, '{UUID}', uuid()) id", "timestamp_ntz'2025-01-01' ts")
    assert mark_duplicates(df, "id", "ts", "n").filter("not kept").count() == 9_999


def test_ranges_merge(spark):
    rows = [("p", 1, 3), ("p", 4, 4), ("p", 9, 12), ("p", 10, 11), ("q", 1, 1), ("r", 5, BLOCK - 1), ("r", BLOCK, 3 * BLOCK + 7), ("r", 3 * BLOCK + 9, 3 * BLOCK + 9), ("r", BLOCK - 2, BLOCK + 2)]
    got = sorted(tuple(r) for r in merge_ranges(spark.createDataFrame(rows, RANGES)).collect())
    assert got == [("p", 1, 4), ("p", 9, 12), ("q", 1, 1), ("r", 5, 3 * BLOCK + 7), ("r", 3 * BLOCK + 9, 3 * BLOCK + 9)]


def test_spellings_of_sequences_are_different_messages(spark):
    ids = ["p-12", "p#12", "p_012", "p-012", "p-12", "p-0", "p-00", "P-12", "12-7", "12-07", "p-12"]
    df = spark.createDataFrame([(i, s, T) for i, s in enumerate(ids)], SCHEMA)
    assert kept(mark_duplicates(df, "id", "ts", "n")) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert kept(accept_all(df, "id", "ts", "n")[0]) == [0, 1, 2, 3, 5, 6, 7, 8, 9]


def test_a_gapless_producer_is_one_range(spark):
    df = spark.range(2 * BLOCK + 500).selectExpr("id n", "concat('dev-', id) id", "timestamp_ntz'2025-01-01' + make_dt_interval(0, 0, 0, id % 977) ts")
    marked, ranges = accept_all(df.union(df.selectExpr("n + 1000000", "id", "ts")), "id", "ts", "n", 3)
    assert marked.filter("kept").count() == 2 * BLOCK + 500 and [tuple(r) for r in ranges.collect()] == [("dev-", 0, 2 * BLOCK + 499)]


def test_a_table_in_batches_is_the_table_at_once(spark):
    rng = random.Random(7)
    rows = [(n, rng.choice([None, "", UUID, "odd", f"a-{rng.randint(0, 30)}", f"b:{rng.randint(BLOCK - 9, BLOCK + 9)}"]), None if rng.random() < 0.1 else T + dt.timedelta(hours=rng.randint(0, 99))) for n in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = kept(mark_duplicates(df, "id", "ts", "n"))
    for batches in (1, 3, 5):
        assert kept(accept_all(df, "id", "ts", "n", batches)[0]) == want
    assert accept_all(df.limit(0), "id", "ts", "n")[0].count() == 0


def test_batches_against_brute_force(spark):
    rng = random.Random(1)
    seen, number = set(), 0
    ranges, keys = spark.createDataFrame([], RANGES), spark.createDataFrame([], KEYS)
    for b in range(3):
        batch, want, inside = [], [], set()
        for _ in range(60):
            number += 1
            kind = rng.random()
            raw = f"dev-{rng.randint(0, 2)}:{rng.randint(BLOCK - 20, BLOCK + 20)}" if kind < 0.7 else rng.choice([UUID, UUID[::-1].replace("-", "")[:32], "odd", None])
            batch.append((number, raw, T + dt.timedelta(days=b)))
            if raw is None or (raw not in seen and raw not in inside):
                want.append(number)
            inside.add(raw)
        seen |= inside
        marked, ranges, fresh = accept(spark.createDataFrame(batch, SCHEMA), "id", "ts", "n", ranges, keys)
        keys = keys.union(fresh)
        assert kept(marked) == want
        ranges, keys = spark.createDataFrame(ranges.collect(), RANGES), spark.createDataFrame(keys.collect(), KEYS)
    assert ranges.count() < len([s for s in seen if s and s.startswith("dev")])
