"""The queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Registry
from ..session import materialize
from ..sources import table
from .addresses import locations
from .bpe import count_tokens, encode_corpus
from .links import pairs_of
from .names import same_names
from .packing import CAPACITY, pack
from .spam import judge_pages

REGISTRY = query = Registry()


@query("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


@query("p9_containers")
def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    sized = materialize(count_tokens(table(spark, folder, "documents"), "doc_id", "text"), "p9-sizes")
    return pack(sized, "doc_id", "tokens")


@query("p9_valid", """
select 0 as overfull, count(*) as documents, 0 as split_without_need, 0 as lost_tokens from documents""")
def p9_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Containers above the capacity, documents assigned, short ones that were split, and tokens that are missing."""
    sized = materialize(count_tokens(table(spark, folder, "documents"), "doc_id", "text"), "p9-sizes")
    packed = materialize(pack(sized, "doc_id", "tokens"), "p9-packed")
    overfull = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > CAPACITY).alias("overfull"))
    each = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("sum")).join(sized, "doc_id", "full")
    split = (F.col("parts") > 1) & (F.col("tokens") <= CAPACITY)
    told = each.agg(F.count("parts").alias("documents"), F.count_if(split).alias("split_without_need"), F.coalesce(F.sum(F.abs(F.coalesce("tokens", F.lit(0)) - F.coalesce("sum", F.lit(0)))), F.lit(0)).alias("lost_tokens"))
    return overfull.join(F.broadcast(told)).select("overfull", "documents", "split_without_need", "lost_tokens")  # one row each


@query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return judge_pages(table(spark, folder, "documents"), "doc_id", "text").filter("case").select("doc_id")


@query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_of(_places(spark, folder), "user_id", "location")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return locations(table(spark, folder, "users"), table(spark, folder, "taxonomy_jp_hierarchy"), table(spark, folder, "reading_ref"))


@query("p5_locations")
def p5_locations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user and location that others share, with the number of users there."""
    return _sized(_places(spark, folder), "location")


def _sized(members: DataFrame, group: str) -> DataFrame:
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return members.join(sizes, group)


@query("p3_classes")
def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user that shares a person or organisation with others, with its class and the class's number of users."""
    return _sized(same_names(table(spark, folder, "users"), table(spark, folder, "reading_ref"), _places(spark, folder)), "class")


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = same_names(table(spark, folder, "users"), table(spark, folder, "reading_ref"), _places(spark, folder))
    return pairs_of(found, "member", "class")
