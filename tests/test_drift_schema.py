import json

import numpy as np

from pyspark.sql import functions as F

from tidemill.operators.drift_schema import canonical, fold, parse, plain, propagated, schema_changes, united, valid_records

RULES = [("^(fund_?id|code)$", "fund_id", 1), ("^(category|分類)$", "fund_category", 1), ("^(fee(_rate)?|信託報酬)$", "trust_fee_rate", 1), (".*date$", "some_date", 9)]
FUNDS = [f"F{i:03d}" for i in range(12)]
BASE = {f: {"fund_id": f, "category": ["BOND", "REIT", "INDEX"][i % 3], "fee": 0.5 + i / 100, "live": i % 4 != 0, "bench": f"Index {i * 7}"} for i, f in enumerate(FUNDS)}


def run(spark, files):
    """files: list of (feed, day, lines)"""
    heads = [(i, feed, day) for i, (feed, day, _) in enumerate(files)]
    lines = [(i, n, line) for i, (_, _, ls) in enumerate(files) for n, line in enumerate(ls)]
    f = spark.createDataFrame(heads, "file_id bigint, feed string, day string").withColumn("delivered_on", F.to_date("day")).drop("day")
    out = schema_changes(f, spark.createDataFrame(lines, "file_id bigint, line_no int, line string"), RULES)
    return sorted((r["file_id"], r["kind"], r["name"]) for r in out.filter("kind <> 'column'").collect())


def dump(change=lambda r: r, funds=FUNDS):
    return [json.dumps(change(dict(BASE[f])), ensure_ascii=False) for f in funds]


def renamed(old, new):
    return lambda r: {new if k == old else k: v for k, v in r.items()}


def test_every_kind_of_change(spark):
    def fourth(r):
        r = renamed("bench", "yardstick")(r)  # a name no rule knows, told by its values
        r["fee"] = str(r["fee"])  # retyped
        return r

    def fifth(r):
        r = fourth(r)
        del r["live"]
        r["note"] = "text " + r["fund_id"]
        return {"信託報酬" if k == "fee" else k: (float(v) if k == "fee" else v) for k, v in r.items()}  # renamed and retyped

    files = [("a", "2025-01-01", dump()), ("a", "2025-01-02", dump(renamed("category", "分類"))), ("a", "2025-01-03", dump()), ("a", "2025-01-04", dump(fourth)), ("a", "2025-01-05", dump(fifth))]
    assert run(spark, files) == [
        (1, "renamed", "分類"), (2, "renamed", "category"), (3, "renamed", "yardstick"), (3, "retyped", "fee"),
        (4, "added", "note"), (4, "removed", "live"), (4, "renamed", "信託報酬"), (4, "retyped", "信託報酬"),
    ]


def test_noise_is_no_change(spark):
    noisy = [None, "", "{broken", "[1]", '"text"', '{"fund_id": "F001", "fe'] + dump() + dump(funds=FUNDS[:1])
    stray = json.dumps({**BASE["F003"], "stray": 1})
    nulls = dump(lambda r: {**r, "fee": None})
    assert run(spark, [("a", "2025-01-01", dump()), ("a", "2025-01-02", noisy), ("a", "2025-01-03", dump()[:11] + [stray]), ("a", "2025-01-04", nulls), ("a", "2025-01-05", dump())]) == []


def test_a_new_field_is_not_a_rename(spark):
    swapped = dump(lambda r: {**{k: v for k, v in r.items() if k != "bench"}, "currency": "JPY" if r["live"] else "USD"})
    assert run(spark, [("a", "2025-01-01", dump()), ("a", "2025-01-02", swapped)]) == [(1, "added", "currency"), (1, "removed", "bench")]


def test_half_of_the_records_and_empty_files(spark):
    half = dump(funds=FUNDS[:6]) + dump(lambda r: {k: v for k, v in r.items() if k != "live"}, FUNDS[6:])
    less = dump(funds=FUNDS[:5]) + dump(lambda r: {k: v for k, v in r.items() if k != "live"}, FUNDS[5:])
    assert run(spark, [("a", "2025-01-01", dump()), ("a", "2025-01-02", half), ("a", "2025-01-03", less)]) == [(2, "removed", "live")]
    assert run(spark, [("a", "2025-01-01", [])]) == []


def test_united(spark):
    f = spark.createDataFrame([(1, "a", None)], "file_id bigint, feed string, delivered_on date")
    lines = spark.createDataFrame([(1, 1, line) for line in dump(renamed("fee", "fee_rate")) + ["{bad"]], "file_id bigint, line_no int, line string")
    out = united(f, lines, schema_changes(f, lines, RULES), {"fund_id": "string", "fund_category": "string", "trust_fee_rate": "decimal(6,3)", "is_active": "boolean"}).toPandas()
    assert len(out) == 12 and out.trust_fee_rate.notna().all() and out.is_active.isna().all() and "bench" in out.extras[0]


def test_small_parts():
    assert parse('{"a": NaN}') is None and parse("﻿{}") == {} and parse(None) is None
    assert plain("2010/07/31") == plain(20100731) == plain("20100731") and plain("1.50") == plain(1.5) and plain(True) == plain("Y") == plain(1)
    assert canonical("Birth Date", RULES) == ("some_date", 9) and fold(" ＡＢ ") == "ab"


def test_renames_are_decided_on_all_records(spark):
    """No fund is in both files, and only all 1,000 values together show that the two columns are one."""
    lines = lambda start, name: [json.dumps({"fund_id": f"G{start + i:05d}", name: f"Index {i * 7}"}) for i in range(1000)]
    assert run(spark, [("a", "2025-01-01", lines(0, "bench")), ("a", "2025-01-02", lines(5000, "yardstick"))]) == [(1, "renamed", "yardstick")]


def changes(spark, files, **more):
    heads = spark.createDataFrame([(i, feed, day) for i, (feed, day, _) in enumerate(files)], "file_id bigint, feed string, day string").withColumn("delivered_on", F.to_date("day"))
    lines = spark.createDataFrame([(i, n, line) for i, (_, _, ls) in enumerate(files) for n, line in enumerate(ls)], "file_id bigint, line_no int, line string")
    return sorted((r["file_id"], r["kind"], r["name"]) for r in schema_changes(heads, lines, RULES, **more).filter("kind <> 'column'").collect())


def test_the_propagation_decides(spark):
    """Names alone find nothing here; with propagation the pairs that share records win over those that only look alike."""
    files = [("a", "2025-01-01", dump()), ("a", "2025-01-02", dump(renamed("bench", "yardstick"))), ("a", "2025-01-03", dump(lambda r: renamed("category", "分類")(renamed("bench", "yardstick")(r))))]
    assert changes(spark, files) == [(1, "renamed", "yardstick"), (2, "renamed", "分類")]
    assert changes(spark, files, steps=0) == [(1, "added", "yardstick"), (1, "removed", "bench"), (2, "added", "分類"), (2, "removed", "category")]


def test_pairs_compete_for_a_column():
    start, none = np.array([[0.1, 0.1], [0.1, 0.1]]), np.zeros((2, 2))
    records = np.array([[0.9, 0.6], [0.5, 0.1]])
    score = propagated(start, records, none)
    assert score[0, 0] > 0.95 and score[1, 0] < 0.5 and score[0, 1] < 0.55  # what the strongest claims, others do not get
    assert (propagated(start, records, none, 0) == start).all()


def test_nested_keys_count(spark):
    """No values are shared and the names differ; only the keys inside tell which column goes on."""
    make = lambda start, a, b: [json.dumps({"fund_id": f"G{start + i}", a: {"low": start + i, "high": [{"unit": str(start + i)}]}, b: {"street": f"s{start + i}"}}) for i in range(9)]
    got = changes(spark, [("a", "2025-01-01", make(0, "band_x", "home_x")), ("a", "2025-01-02", make(500, "band_y", "home_y"))])
    assert got == [(1, "renamed", "band_y"), (1, "renamed", "home_y")]


def test_one_definition_of_a_valid_line(spark):
    odd = ['﻿{"fund_id": "F1"}', '{"fund_id": NaN}', '{"fund_id": "F2"} x', '{"fund_id": "F3", "fee": 0.50}', "{}", "[1]", None, '{"fund_id": "F4", "fund_id": "F5"}']
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(odd)], "file_id bigint, line_no int, line string")
    f = spark.createDataFrame([(1, "a", None)], "file_id bigint, feed string, delivered_on date")
    read = valid_records(lines).collect()
    assert len(read) == sum(parse(x) is not None for x in odd) == 4 and {r["_values"].get("fee") for r in read} == {"0.50", None}
    out = united(f, lines, schema_changes(f, lines, RULES), {"fund_id": "string", "trust_fee_rate": "decimal(6,3)"}).collect()
    assert sorted(str(r["fund_id"]) for r in out) == ["F1", "F3", "F5", "None"]
