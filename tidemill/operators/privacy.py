"""Pseudonyms, generalisation, k-anonymous cells, sensitive patterns, masks and row filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OTHER = "Other"

# Regions by prefecture; the first and default region takes addresses without a known prefecture.
REGIONS = {
    "北海道": ["北海道"],
    "東北": ["青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県"],
    "関東": ["茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県"],
    "中部": ["新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県"],
    "近畿": ["三重県", "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県"],
    "中国": ["鳥取県", "島根県", "岡山県", "広島県", "山口県"],
    "四国": ["徳島県", "香川県", "愛媛県", "高知県"],
    "九州・沖縄": ["福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県"],
}
PREFECTURE = r"^(?:〒?\s*[0-9-]*\s*)?(北海道|(?:東京|京都|大阪).|[^\s0-9]{2,3}?[都府県])"
CITY = r"(?:北海道|[都府県])\s*([^\s0-9]{1,6}?[市区町村])"


def token(value: Column, salt: str = "", length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, length)


def prefecture(address: Column) -> Column:
    return F.regexp_extract(address, PREFECTURE, 1)


def city(address: Column) -> Column:
    return F.regexp_extract(address, CITY, 1)


def region(pref: Column) -> Column:
    names = list(REGIONS)
    chain = F.when(pref.isin(*REGIONS[names[1]]), names[1])
    for name in names[2:]:
        chain = chain.when(pref.isin(*REGIONS[name]), name)
    return chain.otherwise(names[0])


def age_band(birth: Column, as_of: str, width: int = 5) -> Column:
    """``20-24`` for ages from 20 to 24; null without a birth date."""
    age = F.floor(F.months_between(F.lit(as_of).cast("date"), birth) / 12).cast("int")
    low = F.floor(age / width).cast("int") * width
    return F.when(birth.isNotNull(), F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string")))


def encrypt(value: Column, key_hex: str) -> Column:
    """AES-GCM with a random nonce: the same text gives another cipher text every time."""
    return F.aes_encrypt(value, F.unhex(F.lit(key_hex)))


def decrypt(value: Column, key_hex: str) -> Column:
    return F.aes_decrypt(value, F.unhex(F.lit(key_hex))).cast("string")


def pseudonymize(df: DataFrame, identifiers: dict[str, str], salt: str, drop: list[str], secret: dict[str, str] | None = None, key_hex: str | None = None) -> DataFrame:
    """Token columns (new name by source column), encrypted columns, and the sources and other identifiers dropped."""
    out = df.withColumns({new: token(F.col(old), salt) for old, new in identifiers.items()})
    if secret:
        out = out.withColumns({new: encrypt(F.col(old), key_hex) for old, new in secret.items()})
    return out.drop(*identifiers, *(secret or {}), *drop)


def cells(df: DataFrame, quasi: list[str], user: str, amount: str, quantity: str) -> DataFrame:
    """Aggregate of every cell of quasi-identifiers."""
    return df.groupBy(*quasi).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(user).alias("users"), F.sum(amount).alias("sales"), F.sum(quantity).alias("quantity"), F.round(F.avg(amount), 2).alias("average")
    )


def k_violations(df: DataFrame, quasi: list[str], user: str, k: int) -> DataFrame:
    """Cells with fewer than k distinct users."""
    return df.groupBy(*quasi).agg(F.count_distinct(user).alias("users")).filter(F.col("users") < k)


def k_anonymize(
    df: DataFrame, quasi: list[str], user: str, amount: str, quantity: str, k: int, relabel: list[str], exact_distinct: bool = True, dummies: bool = False, noise_seed: int | None = None
) -> DataFrame:
    """Cells of at least k users; smaller ones take the label Other in the ``relabel`` columns and are merged.

    Relabelled cells group by the same keys in every further round, so one merge is the fixed point.  A merged cell counts
    its distinct users anew from the rows; without ``exact_distinct`` it adds up those of its parts, where one user may
    count twice and a cell of fewer than k users may pass.
    ``dummies`` fills a merged cell that is still too small up to k users; noise moves sales by at most 3 per cent.
    """
    parts = cells(df, quasi, user, amount, quantity)
    small = F.col("users") < k
    relabelled = parts.withColumns({c: F.when(small, F.lit(OTHER)).otherwise(F.col(c).cast("string")) for c in relabel})
    merged = relabelled.groupBy(*quasi).agg(*(F.sum(c).alias(c) for c in ("rows", "users", "sales", "quantity")))
    if exact_distinct:
        marks = parts.filter(small).select(*(F.col(c).alias(f"_q_{c}") for c in quasi), F.lit(True).alias("_small"))
        condition = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in quasi))
        rows = df.select(*quasi, user).join(marks, condition, "left")
        rows = rows.select(*(F.when(F.col("_small"), F.lit(OTHER)).otherwise(F.col(c).cast("string")).alias(c) if c in relabel else F.col(c) for c in quasi), user)
        counted = rows.groupBy(*(F.col(c).alias(f"_q_{c}") for c in quasi)).agg(F.count_distinct(user).alias("_users"))
        merged = merged.join(counted, condition).select(*quasi, "rows", F.col("_users").alias("users"), "sales", "quantity")
    out = merged.withColumn("average", F.round(F.col("sales") / F.col("rows"), 2)).withColumn("is_small", F.col("users") < k)
    if dummies:
        short = F.greatest(F.lit(k) - F.col("users"), F.lit(0))
        filler = out.filter("is_small").select(*quasi, F.explode(F.sequence(F.lit(1), short.cast("int")))).drop("col")
        blank = [F.lit(0).cast(dict(out.dtypes)[c]).alias(c) for c in out.columns if c not in quasi and c not in ("users", "is_small")]
        filler = filler.select(*quasi, F.lit(1).cast("bigint").alias("users"), *blank, F.lit(False).alias("is_small"))
        out = out.unionByName(filler).groupBy(*quasi).agg(*(F.sum(c).alias(c) for c in ("rows", "users", "sales", "quantity")), F.max("average").alias("average"))
        out = out.withColumn("is_small", F.col("users") < k)
    if noise_seed is not None:
        out = out.withColumn("sales", F.col("sales") * (1 + (F.rand(noise_seed) - 0.5) * 0.06))
    return out


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def pattern_counts(df: DataFrame, pattern: str) -> DataFrame:
    """Rows that match in each text column, counted in one pass."""
    names = text_columns(df)
    counts = df.agg(*(F.coalesce(F.count_if(F.col(f"`{c}`").rlike(pattern)), F.lit(0)).alias(f"c{i}") for i, c in enumerate(names)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("hits")) for i, c in enumerate(names)))))


def pattern_flags(df: DataFrame, pattern: str) -> DataFrame:
    """Rows that match in any text column, with a flag per column."""
    names = text_columns(df)
    flags = {f"{c}_hit": F.coalesce(F.col(f"`{c}`").rlike(pattern), F.lit(False)) for c in names}
    return df.withColumns(flags).filter(reduce(Column.__or__, (F.col(f"`{n}`") for n in flags)))


# governance


def masked(column: Column) -> Column:
    """Asterisks of the same length."""
    return F.repeat(F.lit("*"), F.length(column))


@dataclass
class Policy:
    """What a role may see: table privileges by first match, row filters and column masks by table."""

    privileges: list[tuple[str, str, str]] = field(default_factory=list)  # role, table prefix, "allow" or "deny"
    filters: dict[tuple[str, str], Callable[[], Column]] = field(default_factory=dict)
    masks: dict[tuple[str, str], dict[str, Callable[[Column], Column]]] = field(default_factory=dict)

    def allowed(self, role: str, table: str) -> bool:
        for who, prefix, verdict in self.privileges:
            if who in (role, "*") and table.startswith(prefix):
                return verdict == "allow"
        return False

    def view(self, df: DataFrame, role: str, table: str) -> DataFrame:
        """The table as the role sees it; the filter is applied to unmasked values."""
        if not self.allowed(role, table):
            raise PermissionError(f"{role} may not read {table}")
        row_filter = self.filters.get((role, table))
        out = df.filter(row_filter()) if row_filter else df
        return out.withColumns({c: f(F.col(c)) for c, f in self.masks.get((role, table), {}).items()})
