"""Column names made safe and canonical at read time.  Names are metadata, so this runs on the driver."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sanitize(name: str, aliases: dict[str, str] | None = None, variants: dict[str, str] | None = None) -> str:
    """Compatibility form; brackets, middle dots, slashes, hyphens and blanks become one underscore; then exact aliases
    and, last, shared variants of words."""
    plain = unicodedata.normalize("NFKC", name.lstrip("﻿"))
    plain = re.sub(r"[()\[\]{}・/\\\-\s]+", "_", plain)
    plain = re.sub(r"_+", "_", plain).strip("_")
    plain = (aliases or {}).get(plain, plain)
    return (variants or {}).get(plain, plain)


def sanitized(df: DataFrame, aliases: dict[str, str] | None = None, variants: dict[str, str] | None = None) -> DataFrame:
    """All columns under their sanitized names; a clash of two names is an error, never a silent overwrite."""
    names = [sanitize(c, aliases, variants) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns clash after sanitizing: {names}")
    return df.toDF(*names)


def alias_renamed(df: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """Rename by regular expressions: by priority and then pattern, without regard to case, the first that fits; skipped
    if the canonical name is already there."""
    ordered = sorted(rules, key=lambda r: (r[2], r[0]))
    taken, renamed = set(df.columns), {}
    for column in df.columns:
        target = next((t for p, t, _ in ordered if re.match(p, column, re.IGNORECASE)), None)
        if target and target not in taken:
            taken.add(target)
            renamed[column] = target
    return df.withColumnsRenamed(renamed)


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN in the given floating-point columns becomes null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
