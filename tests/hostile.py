"""Copies of the smallest test tables that are empty, full of nulls, repeated, or have further columns."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
TABLES = "orders_microbatch_window_raw users fund_master_v2 dim_fund legacy_fund_master column_alias_map taxonomy_jp_hierarchy documents fund_files fund_file_lines reading_ref events".split()
KEYS = {"delivery_no", "file_id", "doc_id", "event_id"}  # unique by definition
EXTRA = ("kept", "status", "_key", "key", "size", "part", "tokens", "rank", "event_day", "label", "evidence", "_n")


def nulled(df, seed):
    def maybe(c):
        salt = int(hashlib.md5(f"{seed}{c}".encode()).hexdigest()[:6], 16)
        return F.when(F.pmod(F.xxhash64(F.lit(salt), F.monotonically_increasing_id()), F.lit(4)) != 0, F.col(f"`{c}`")).alias(c)

    return df.select(*(F.col(f"`{c}`") if c in KEYS else maybe(c) for c in df.columns))


def variant(spark, target: Path, kind: str) -> str:
    for name in TABLES:
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if kind == "empty":
            df = df.limit(0)
        elif kind == "nulls" and name not in ("taxonomy_jp_hierarchy", "reading_ref", "column_alias_map"):
            df = nulled(df.coalesce(1), name)
        elif kind == "reference nulls" and name in ("taxonomy_jp_hierarchy", "reading_ref", "column_alias_map"):
            df = nulled(df.coalesce(1), name)
        elif kind == "extra":
            df = df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, c in enumerate(EXTRA) if c not in df.columns})
        elif kind == "repeated" and not KEYS & set(df.columns):
            df = df.union(df)
        df.coalesce(1).write.mode("overwrite").parquet(str(target / f"{name}.parquet"))
    return str(target)
