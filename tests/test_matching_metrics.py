import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import matching as mt
from tidemill.operators import metrics as x


def brute(a, b, threshold, token):
    out = set()
    for x_, _ in a:
        for y, _ in b:
            s, t = token[x_], token[y]
            if s and t and 1 - len(s & t) / len(s | t) <= threshold + 1e-12:
                out.add((frozenset(s), frozenset(t)))
    return out


def test_jaccard_against_brute_force(spark):
    words = ["Fund", "Alpha", "Beta", "Gamma", "12", "ひかり", "号", "ファンド"]
    names = [" ".join(words[j] for j in range(8) if (i * 37 + 11) % 255 >> j & 1) for i in range(60)] + ["", None, "ﾌｧﾝﾄﾞ　１２"]
    a, b = [(n, i) for i, n in enumerate(names[:30] + names[-3:])], [(n, i) for i, n in enumerate(names[20:])]
    da, db = spark.createDataFrame(a, "t string, id int"), spark.createDataFrame(b, "t string, id int")
    both = da.union(db).distinct().select("t", mt.tokens(F.col("t")).alias("k")).collect()
    token = {r["t"]: set(r["k"]) for r in both}
    for threshold in (0.0, 0.4, 0.7):
        got = mt.similarity_match(da, db, "t", "id", "id", threshold).collect()
        assert {(frozenset(token[r["text_a"]]), frozenset(token[r["text_b"]])) for r in got} == brute(a, b, threshold, token)
        assert len(got) == len({(r["text_a"], r["text_b"]) for r in got})
    approximate = mt.minhash_match(da.filter("t <> ''"), db.filter("t <> ''"), "t", "id", "id", 0.4).count()
    assert 0 < approximate <= mt.similarity_match(da, db, "t", "id", "id", 0.4).count()
    with pytest.raises(ValueError):
        mt.similarity_match(da, db, "t", "id", "id", 1.0)


def test_long_vowel_mark_splits_tokens(spark):
    row = spark.createDataFrame([("グローバルABC株式",)], "t string").select(mt.tokens(F.col("t"))).first()[0]
    assert row == ["グロ", "バル", "abc", "株式"]


def test_deterministic(spark):
    a = spark.createDataFrame([("1", "Ａ　ｂ", "x"), ("2", None, None), ("3", "zz", None)], "id string, n string, c string")
    b = spark.createDataFrame([("9", "aB", "X"), ("8", None, None), ("7", "zz", "")], "id string, n string, c string")
    pairs = mt.deterministic_match(a, b, ["n", "c"], "id", "id")
    assert sorted(map(tuple, pairs.collect())) == [("1", "9"), ("3", "7")]
    assert {r["id"]: r["other"] for r in mt.mapped(a, pairs, "id", "id_a", "id_b", "other").collect()} == {"1": "9", "2": None, "3": "7"}
    fees = spark.createDataFrame([("1", 0.5), ("3", 1.0)], "id string, fee double")
    more = spark.createDataFrame([("9", 0.75), ("7", 1.0)], "id string, fee double")
    assert {r["difference"] for r in mt.with_differences(pairs, fees, more, "id", "id", "fee", "fee").collect()} == {0.25, 0.0}


def test_psi_golden(spark):
    observed = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("c", 0.2), ("d", 0.2)], "k string, share double")
    reference = spark.createDataFrame([("a", 0.26), ("b", 0.2), ("c", 0.3), ("d", 0.24), ("e", 0.0)], "k string, share double")
    got = {r["k"]: (r["term"], r["psi"]) for r in x.psi(observed, reference, "k").collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 0.005724, "b": 0.040547, "c": 0.040547, "d": 0.007293, "e": 0.0} and got["a"][1] == 0.09411


NAV = [("A", dt.date(2025, 1, 30), 100.0), ("A", dt.date(2025, 1, 31), 102.0), ("A", dt.date(2025, 2, 3), 101.0), ("A", dt.date(2025, 2, 4), 105.0), ("B", dt.date(2025, 2, 4), 50.0)]


def nav(spark):
    return spark.createDataFrame(NAV, "f string, d date, p double")


def test_returns(spark):
    gross = {(r["f"], r["month"].month): r["gross"] for r in x.gross_return_month(nav(spark), "f", "d", "p").collect()}
    assert gross == {("A", 1): 2.0, ("A", 2): 4.0, ("B", 2): 0.0}
    fees = spark.createDataFrame([("A", 1.2), ("B", 0.25)], "f string, fee double")
    net = {r["month"].month: r["net"] for r in x.net_return_month(nav(spark), "f", "d", "p", fees, "fee").collect()}
    assert abs(net[2] - (3.0 - (102 + 101) * 0.012 / 365)) < 1e-9
    cut = {r["month"].month: r["net"] for r in x.net_return_month(nav(spark), "f", "d", "p", fees, "fee", two_decimals=True).collect()}
    assert abs(cut[2] - (3.0 - (102 + 101) * 0.01 / 365)) < 1e-9


def test_semantic_layer(spark):
    rows = x.fund_unified(x.fund_abv(nav(spark), "f", "d", "p"), "f", "d")
    cube = x.Cube(rows, {"r": x.Measure("numerator", "denominator", True), "z": x.Measure("numerator", "zero")}, {"period": F.col("period")}, {"month": F.col("grain") == "month"})
    got = {r["period"].month: r["r"] for r in cube.query(["r"], ["period"], "month").collect()}
    assert abs(got[1] - 2.0) < 1e-9 and abs(got[2] - 3 / 102 * 100) < 1e-9
    zero = x.Cube(rows.withColumn("zero", F.lit(0)), cube.measures, cube.dimensions).query(["z"]).first()
    assert zero["z"] is None
    with pytest.raises(KeyError):
        cube.query(["nope"])
