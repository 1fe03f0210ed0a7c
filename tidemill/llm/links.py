"""Links to classes, and classes to pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Members of one group are paired in blocks of this many; only work is divided by it.
BLOCK = 1000


def classes(links: DataFrame, a: str, b: str) -> DataFrame:
    """``member`` and ``class`` (its smallest member) of every linked id, by propagating the smallest id until it stays."""
    there, back = F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y"))
    both = materialize(links.select(F.explode(F.array(there, back)).alias("e")).select("e.*").distinct(), "links")
    label = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("class")).withColumnRenamed("x", "member"), "classes")
    before = None
    while True:
        offered = both.join(label.withColumnRenamed("member", "y"), "y").groupBy("x").agg(F.min("class").alias("_near"))
        # a member also takes the class of its class's own member, which halves long chains
        joined = label.join(offered.withColumnRenamed("x", "member"), "member").withColumn("_next", F.least("class", "_near"))
        jump = label.select(F.col("member").alias("_next"), F.col("class").alias("_far"))
        fresh = joined.join(jump, "_next", "left").select("member", F.least("_next", "_far").alias("class"), (F.least("_next", "_far") < F.col("class")).alias("moved"))
        fresh = materialize(fresh, "classes")
        if before is not None:
            discard(before)  # the last but one; nothing reads it any more
        before, label = fresh, fresh.drop("moved")
        if fresh.filter("moved").isEmpty():
            return label


def pairs_of(members: DataFrame, member: str, group: str) -> DataFrame:
    """All pairs of different members of a group, smaller first.

    A large group is split into blocks: each member goes to one block on the left side and to all on the right, so no
    task holds all pairs of a group.
    """
    sized = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    both = members.join(sized.drop("_n"), group)
    left = both.select(group, F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int").alias("_block"), F.col(member).alias("user_id_a"))
    right = both.select(group, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col(member).alias("user_id_b"))
    return left.join(right, [group, "_block"]).filter("user_id_a < user_id_b").select("user_id_a", "user_id_b").distinct()
