"""Queries that must cover whole tables, beside brute force on small tables of their own."""

import itertools
import re
import unicodedata

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_deterministic_match_of_names_in_any_script(spark, tmp_path):
    new = [("N1", "日本 株式ファンド"), ("N2", "ｸﾞﾛｰﾊﾞﾙ債券"), ("N3", "Ａｂｃ　Fund"), ("N4", "米国REIT"), ("N5", None), ("N6", "日本債券")]
    old = [("O1", "日本株式　ファンド"), ("O2", "グローバル債券"), ("O3", "ABC fund"), ("O4", "米国ＲＥＩＴ"), ("O5", None), ("O6", "外国債券")]
    spark.createDataFrame(new, "fund_id string, fund_name string").write.parquet(f"{tmp_path}/fund_master_v2.parquet")
    spark.createDataFrame(old, "fund_id string, `ファンド名` string").write.parquet(f"{tmp_path}/legacy_fund_master.parquet")
    plain = lambda name: re.sub(r"\s", "", unicodedata.normalize("NFKC", name)).lower()
    want = {(a, b) for (a, x), (b, y) in itertools.product(new, old) if x and y and plain(x) == plain(y)}
    got = entry.queries()["deterministic_match"](spark, str(tmp_path)).collect()
    assert len(want) == 4 and len(got) == 4 and {(r["id_a"], r["id_b"]) for r in got} == want


def test_wide_star_reconcile_covers_every_customer(spark, tmp_path):
    """Customer 9 is in no dimension, so its lines are in the wide table only; customer 7 has no orders."""
    tables = {
        "customer": ([(7, "a", "X"), (8, "b", "Y")], "c_custkey bigint, c_name string, c_mktsegment string"),
        "orders": ([(1, 8), (2, 9)], "o_orderkey bigint, o_custkey bigint"),
        "part": ([(5, "p", "q")], "p_partkey bigint, p_name string, p_brand string"),
        "lineitem": ([(1, 1, 5, 2.0), (1, 1, 5, 2.0), (2, 1, 5, 3.0), (2, 2, 5, 4.0)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumns({"o_orderdate": F.lit("2025-01-01").cast("timestamp"), "o_orderstatus": F.lit("O")})
        if name == "lineitem":
            df = df.withColumns({"l_quantity": F.lit(1.0), "l_discount": F.lit(0.0), "l_shipdate": F.lit("2025-01-01").cast("timestamp")})
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = entry.queries()["wide_star_reconcile"](spark, str(tmp_path)).collect()
    assert sorted((r["l_orderkey"], r["l_linenumber"], r["only_in"]) for r in got) == [(2, 1, "a"), (2, 2, "a")]
