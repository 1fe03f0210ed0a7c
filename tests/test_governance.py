import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import contract as c
from tidemill.operators import privacy as p
from tidemill.operators import quality as q

DOC = '{"fields": [ // see https://x.example/a\n {"name": "id", "type": "string", "rules": {"pattern": "^[0-9]+$"}}, {"name": "n", "type": ["null", "int"], "rules": {"min": 0, "null_fails": true}}, {"name": "t", "type": "string", "default": "d", "rules": {"min_length": 1}},], "row_rules": [{"name": "r", "expr": "n < 5"}]}'


def test_contract(spark):
    contract = c.load(DOC)
    df = spark.createDataFrame([("1", "3", "x"), ("a", "oops", None), (None, "7", "y")], "id string, n string, more string")
    assert c.schema_drift(df, contract) == {"unexpected": ["more"], "missing": ["t"], "mismatched": [("n", "string", "int")]}
    cast = c.contract_cast(df, contract)
    assert cast.columns == ["id", "n", "t", "_extras"] and cast.first()["t"] == "d" and [r["_extras"] for r in cast.collect()] == [{"more": "x"}, {}, {"more": "y"}]
    checked = c.contract_validate(cast, contract)
    assert [r["_violations"] for r in checked.collect()] == [[], ["id_pattern", "n_range", "r"], ["r"]]
    good, bad = c.split(checked)
    assert (good.count(), bad.count()) == (1, 2)
    assert [tuple(r) for r in c.violation_counts(checked).collect()] == [("r", 2), ("id_pattern", 1), ("n_range", 1)]
    assert c.spark_type({"type": "bytes", "logicalType": "decimal", "precision": 5, "scale": 2}) == "decimal(5,2)" and c.spark_type({"type": "enum", "symbols": []}) == "string"


def test_gates():
    assert c.gate({"missing": ["x"]}) == 2 and c.gate({"missing": []}) == 0 and c.gate(duplicates=1) == 4
    assert c.gate(bad=5, total=10, max_bad=4) == 3 and c.gate(bad=5, total=10, max_rate=0.4) == 3 and c.gate(bad=5, total=10) == 0


def test_slo(spark):
    df = spark.createDataFrame([(None, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1, 0, 5)), (dt.datetime(2025, 1, 1, 1), None, dt.datetime(2025, 1, 1, 3))], "u timestamp, c timestamp, l timestamp")
    assert c.slo_latency(df, "u", "c", "l", 600).first()["ok_ratio"] == 0.5
    assert c.slo_latency(df, "u", "c", "l", None).first()["ok_ratio"] is None
    assert tuple(c.slo_latency(df.limit(0), "u", "c", "l", 600).first()) == (0, None, None)


def test_quality(spark):
    df = spark.createDataFrame([(1, 5.0), (None, 1.0), (1, None)], "k int, v double")
    report = {r["column"] + r["rule"]: r for r in q.run_rules(df, [q.complete("k", 0.5), q.between("v", 0, 4)]).collect()}
    assert (report["kis_complete"]["violations"], report["kis_complete"]["status"]) == (1, "PASS") and report["vis_between"]["violations"] == 2
    assert q.unique(df, "k").first()["violations"] == 1
    assert q.references(df, "k", spark.createDataFrame([(2,)], "x int"), "x").first()["violations"] == 3
    assert q.run_rules(df.limit(0), [q.complete("k")]).first()["pass_rate"] == 1.0
    many = spark.range(101).selectExpr("cast(id as double) v").union(spark.createDataFrame([(1000.0,)], "v double"))
    assert [r["v"] for r in q.outliers(many, "v", exact=True).collect()] == [1000.0] and q.outliers(many, "v").count() == 1
    damaged = spark.createDataFrame([("ok",), ("ﾊﾝｶｸ",), ("�",), (None,)], "t string")
    assert damaged.filter(q.text_damage("t")).count() == 2


def test_generalisation(spark):
    df = spark.createDataFrame([("東京都千代田区1-1", dt.date(2000, 6, 2)), ("somewhere", None), ("北海道札幌市", dt.date(1999, 1, 1))], "a string, b date")
    out = df.select(p.prefecture(F.col("a")).alias("p"), p.city(F.col("a")).alias("c"), p.age_band(F.col("b"), "2025-06-01").alias("g")).withColumn("r", p.region(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [("東京都", "千代田区", "20-24", "関東"), ("", "", None, "北海道"), ("北海道", "札幌市", "25-29", "北海道")]


def test_k_anonymity(spark):
    rows = [("m", "a", u, 10.0, 1) for u in (1, 2, 3)] + [("m", "b", 1, 5.0, 1), ("m", "c", 1, 7.0, 2)]
    df = spark.createDataFrame(rows, "month string, seg string, u int, v double, n int")
    run = lambda **o: {r["seg"]: r for r in p.k_anonymize(df, ["month", "seg"], "u", "v", "n", 3, ["seg"], **o).collect()}
    plain = run(exact_distinct=False)
    assert (plain["Other"]["users"], plain["Other"]["sales"], plain["Other"]["is_small"], plain["a"]["users"]) == (2, 12.0, True, 3)
    assert run()["Other"]["users"] == 1 and run()["Other"]["is_small"]
    filled = run(exact_distinct=False, dummies=True)
    assert filled["Other"]["users"] == 3 and not filled["Other"]["is_small"] and filled["Other"]["sales"] == 12.0
    assert sum(r["sales"] for r in plain.values()) == 42.0
    noisy = run(noise_seed=1)
    assert abs(noisy["a"]["sales"] - 30) <= 0.9
    assert {r["seg"] for r in p.k_violations(df, ["month", "seg"], "u", 3).collect()} == {"b", "c"}


def test_tokens_and_secrets(spark):
    df = spark.createDataFrame([("7", "Ann"), (None, None)], "id string, name string")
    out = p.pseudonymize(df, {"id": "token"}, "s", [], {"name": "cipher"}, "00" * 16)
    assert out.columns == ["token", "cipher"]
    assert [tuple(r) for r in out.select(F.length("token"), p.decrypt(F.col("cipher"), "00" * 16)).collect()] == [(16, "Ann"), (None, None)]


def test_scan_and_access(spark):
    df = spark.createDataFrame([("STRAT-ABC-01", None), ("x", "y")], "a string, b string")
    assert {r["column"]: r["hits"] for r in p.pattern_counts(df, "STRAT-[A-Z]{3}-[0-9]{2}").collect()} == {"a": 1, "b": 0}
    assert p.pattern_flags(df, "STRAT").collect()[0]["a_hit"] and p.pattern_counts(df.limit(0), "x").first()["hits"] == 0
    policy = p.Policy([("analyst", "bronze.", "deny"), ("*", "", "allow")], {("analyst", "t"): lambda: F.col("a") == "x"}, {("analyst", "t"): {"a": p.masked}})
    assert [tuple(r) for r in policy.view(df, "analyst", "t").collect()] == [("*", "y")]
    with pytest.raises(PermissionError):
        policy.view(df, "analyst", "bronze.t")
