"""Fund returns, a semantic layer of ratio-of-sums measures, and distribution drift."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psi(observed: DataFrame, reference: DataFrame, key: str, share: str = "share", eps: float = 1e-9) -> DataFrame:
    """Terms and total of the population stability index; a class that one side lacks has share 0 there, shares are
    clamped to [eps, 1 - eps]."""
    joined = observed.select(key, F.col(share).alias("_b")).join(reference.select(key, F.col(share).alias("_r")), key, "full")
    clamp = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(eps)), F.lit(1 - eps))
    b, r = clamp(F.col("_b")), clamp(F.col("_r"))
    terms = joined.select(key, ((b - r) * F.log(b / r)).alias("_term"))
    total = terms.agg(F.sum("_term").alias("_psi"))  # one row
    return terms.join(F.broadcast(total)).select(key, F.round("_term", 6).alias("term"), F.round("_psi", 6).alias("psi"))


def shares(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return counts.join(F.broadcast(total)).select(key, (F.col("_n") / F.col("_all")).alias("share"))


def daily_changes(nav: DataFrame, fund: str, day: str, price: str) -> DataFrame:
    """Price, the price before and the change; a fund's first day has none."""
    before = F.lag(price).over(Window.partitionBy(fund).orderBy(day))
    return nav.withColumn("previous", before).filter("previous is not null").withColumn("diff", F.col(price) - F.col("previous"))


def fund_abv(nav: DataFrame, fund: str, day: str, price: str) -> DataFrame:
    """Daily numerators and denominators at three grains: the price before each day, and on the first row of each month
    and year the price the period began with (null on other rows, so sums over a period count it once)."""
    rows = daily_changes(nav, fund, day, price)
    out = rows
    for grain in ("month", "year"):
        first = F.row_number().over(Window.partitionBy(fund, F.trunc(day, grain)).orderBy(day)) == 1
        out = out.withColumn(f"denominator_{grain}", F.when(first, F.col("previous")))
    return out.select(fund, day, price, "diff", F.col("previous").alias("denominator_day"), "denominator_month", "denominator_year")


def fund_unified(abv: DataFrame, fund: str, day: str) -> DataFrame:
    """One table of three grains with a label; each grain has its own denominator."""
    def grain(label: str, period: Column) -> DataFrame:
        return abv.groupBy(F.col(fund), period.alias("period")).agg(F.sum("diff").alias("numerator"), F.sum(f"denominator_{label}").alias("denominator")).withColumn("grain", F.lit(label))

    return grain("day", F.col(day)).unionByName(grain("month", F.trunc(day, "month"))).unionByName(grain("year", F.trunc(day, "year")))


def gross_return_month(nav: DataFrame, fund: str, day: str, price: str) -> DataFrame:
    """Last price minus first price of each month."""
    return nav.groupBy(fund, F.trunc(day, "month").alias("month")).agg((F.max_by(price, day) - F.min_by(price, day)).alias("gross"))


def net_return_month(nav: DataFrame, fund: str, day: str, price: str, fees: DataFrame, rate: str, two_decimals: bool = False) -> DataFrame:
    """Sum over days of the change minus the day's fee on the price before.

    ``rate`` is in per cent a year.  ``two_decimals`` cuts the rate as a fraction to two decimals, as engines whose
    decimal division keeps the scale of its input do.
    """
    fraction = F.col(rate).cast("double") / 100
    if two_decimals:
        fraction = F.floor(fraction * 100 + 1e-9) / 100
    rows = daily_changes(nav, fund, day, price).join(fees.select(fund, fraction.alias("_fee")), fund)
    net = F.col("diff") - F.col("previous") * F.col("_fee") / 365
    return rows.groupBy(fund, F.trunc(day, "month").alias("month")).agg(F.sum(net).alias("net"))


@dataclass(frozen=True)
class Measure:
    """A ratio of sums; a zero denominator gives null."""

    numerator: str
    denominator: str
    percent: bool = False

    def column(self, segment: Column | None = None) -> Column:
        pick = (lambda c: F.when(segment, F.col(c))) if segment is not None else F.col
        ratio = F.sum(pick(self.numerator)) / F.nullif(F.sum(pick(self.denominator)).cast("double"), F.lit(0.0))
        return ratio * 100 if self.percent else ratio


@dataclass
class Cube:
    """Metric definitions over one table, compiled to a single aggregate."""

    source: DataFrame
    measures: dict[str, Measure]
    dimensions: dict[str, Column]
    segments: dict[str, Column] = field(default_factory=dict)

    def query(self, measures: list[str], dimensions: list[str] = (), segment: str | None = None, filters: list[Column] = ()) -> DataFrame:
        unknown = [m for m in measures if m not in self.measures] + [d for d in dimensions if d not in self.dimensions]
        if unknown or (segment and segment not in self.segments):
            raise KeyError(f"not defined: {unknown or segment}")
        rows = self.source.filter(self.segments[segment]) if segment else self.source
        for condition in filters:
            rows = rows.filter(condition)
        return rows.groupBy(*(self.dimensions[d].alias(d) for d in dimensions)).agg(*(self.measures[m].column().alias(m) for m in measures))
