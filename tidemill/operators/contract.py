"""Data contracts: a JSON schema document with rules, applied as casts, checks and gates."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIMITIVE = {"string": "string", "int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "bytes": "binary"}


def load(text: str) -> dict:
    """A contract document; comments (outside strings) and trailing commas are allowed."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.DOTALL)
    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m.group(1) or m.group(2), kept))


def spark_type(kind: object) -> str:
    """Spark type of an Avro type: unions give their first type that is not null, logical types their counterpart."""
    if isinstance(kind, list):
        return spark_type(next(k for k in kind if k != "null"))
    if isinstance(kind, dict):
        logical = kind.get("logicalType")
        if logical == "decimal":
            return f"decimal({kind['precision']},{kind.get('scale', 0)})"
        if logical in ("timestamp-millis", "timestamp-micros"):
            return "timestamp"
        if logical == "date":
            return "date"
        inner = kind["type"]
        if inner == "enum":
            return "string"
        if inner == "array":
            return f"array<{spark_type(kind['items'])}>"
        if inner == "map":
            return f"map<string,{spark_type(kind['values'])}>"
        return spark_type(inner)
    return _PRIMITIVE[kind]


def contract_cast(df: DataFrame, contract: dict) -> DataFrame:
    """Contract columns in contract order and types (null where a value does not fit); missing ones from their defaults;
    surplus columns as text in the map ``_extras``."""
    fields = contract["fields"]
    names = [f["name"] for f in fields]
    out = [
        (F.col(f"`{f['name']}`").try_cast(spark_type(f["type"])) if f["name"] in df.columns else F.lit(f.get("default")).cast(spark_type(f["type"]))).alias(f["name"])
        for f in fields
    ]
    surplus = [c for c in df.columns if c not in names]
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in surplus)), lambda p: p.v.isNotNull()) if surplus else None
    extras = F.map_from_entries(pairs) if surplus else F.lit(None).cast("map<string,string>")
    return df.select(*out, extras.alias("_extras"))


def rules(contract: dict) -> dict[str, Column]:
    """Name of each rule and when it holds.  Patterns and ranges hold for null unless ``null_fails``; a least length does
    not; row rules must be true."""
    out: dict[str, Column] = {}
    for f in contract["fields"]:
        c, q = F.col(f"`{f['name']}`"), f.get("rules", {})
        if "pattern" in q:
            out[f"{f['name']}_pattern"] = c.isNull() | c.cast("string").rlike(q["pattern"])
        if "min" in q or "max" in q:
            holds = F.lit(True)
            if "min" in q:
                holds = holds & (c >= q["min"])
            if "max" in q:
                holds = holds & (c <= q["max"])
            out[f"{f['name']}_range"] = (c.isNotNull() & holds) if q.get("null_fails") else (c.isNull() | holds)
        if "min_length" in q:
            out[f"{f['name']}_min_length"] = F.coalesce(F.length(c.cast("string")) >= q["min_length"], F.lit(False))
        if "domain" in q:
            out[f"{f['name']}_domain"] = c.isNull() | c.isin(*q["domain"])
    for r in contract.get("row_rules", []):
        out[r["name"]] = F.coalesce(F.expr(r["expr"]), F.lit(False))
    return out


def contract_validate(df: DataFrame, contract: dict) -> DataFrame:
    """All rows with ``_violations``, the names of the rules they break, in rule order."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules(contract).items()]
    return df.withColumn("_violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.filter("size(_violations) = 0").drop("_violations"), validated.filter("size(_violations) > 0")


def violation_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("_violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "rule")


def schema_drift(df: DataFrame, contract: dict) -> dict[str, list]:
    """Unexpected and missing columns, and common ones of another type, before any cast."""
    have, want = dict(df.dtypes), {f["name"]: spark_type(f["type"]) for f in contract["fields"]}
    return {
        "unexpected": sorted(have.keys() - want.keys()),
        "missing": sorted(want.keys() - have.keys()),
        "mismatched": sorted((c, have[c], want[c]) for c in have.keys() & want.keys() if have[c] != want[c]),
    }


def pk_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def slo_latency(df: DataFrame, updated: str, created: str, loaded: str, threshold_s: int | None, exact: bool = False) -> DataFrame:
    """One row: rows, share within the threshold, 95th percentile of seconds (approximate unless ``exact``, which
    keeps all different values in one task); ratios are null without rows or threshold."""
    event = F.coalesce(F.col(updated), F.col(created)).cast("timestamp")
    lag = F.unix_timestamp(F.col(loaded).cast("timestamp")) - F.unix_timestamp(event)
    ok = F.avg(F.when(F.col("lag") <= threshold_s, 1.0).when(F.col("lag").isNotNull(), 0.0)) if threshold_s is not None else F.lit(None).cast("double")
    return df.select(lag.alias("lag")).agg(F.count("lag").alias("rows"), ok.alias("ok_ratio"), (F.percentile("lag", 0.95) if exact else F.percentile_approx("lag", 0.95, 10_000).cast("double")).alias("p95_s"))


def gate(drift: dict | None = None, duplicates: int = 0, bad: int = 0, total: int = 0, max_bad: int = 0, max_rate: float = 0.0, allow_drift: bool = False) -> int:
    """Exit code of a run: 2 drift, 4 duplicate keys, 3 too many bad rows or too high a rate; a limit of 0 is no limit."""
    if drift and any(drift.values()) and not allow_drift:
        return 2
    if duplicates:
        return 4
    if (max_bad and bad > max_bad) or (max_rate and total and bad / total > max_rate):
        return 3
    return 0

