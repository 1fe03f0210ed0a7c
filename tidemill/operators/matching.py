"""Matching of records by normalised keys, by exact Jaccard similarity of tokens, and by MinHash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_width

#: Runs of one script; the long-vowel mark belongs to none, so it ends a run.
SCRIPT_RUNS = r"(\p{IsHan}+|\p{IsHiragana}+|[ァ-ヺ]+|[a-z0-9]+)"


def normal(text: Column) -> Column:
    """One width, lower case, no blanks; null gives the empty text."""
    return F.coalesce(F.regexp_replace(F.lower(fold_width(text)), r"\s+", ""), F.lit(""))


def match_key(columns: list[str]) -> Column:
    return F.concat_ws("_", *(normal(F.col(c)) for c in columns))


def deterministic_match(a: DataFrame, b: DataFrame, columns: list[str], id_a: str, id_b: str) -> DataFrame:
    """Pairs of ids whose normalised key columns are all equal; rows without any of them match nothing."""
    def keyed(df: DataFrame, name: str, alias: str) -> DataFrame:
        some = reduce(Column.__or__, (F.col(c).isNotNull() for c in columns))
        return df.filter(some).select(F.col(name).alias(alias), match_key(columns).alias("_key"))

    return keyed(a, id_a, "id_a").join(keyed(b, id_b, "id_b"), "_key").select("id_a", "id_b").distinct()


def mapped(df: DataFrame, pairs: DataFrame, key: str, pair_key: str, other: str, alias: str) -> DataFrame:
    """The business key of the other side, null where there is no match."""
    return df.join(pairs.select(F.col(pair_key).alias(key), F.col(other).alias(alias)), key, "left")


def tokens(text: Column) -> Column:
    """Distinct script runs of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(fold_width(F.coalesce(text, F.lit("")))), F.lit(SCRIPT_RUNS), F.lit(1)))


def regex_tokens(df: DataFrame, text: str, alias: str, pattern: str = r"[\p{IsHan}ぁ-んァ-ヺ]+|[a-z0-9]+") -> DataFrame:
    """Tokens of a text by the pattern they match, as an estimator's stage; null texts have none."""
    from pyspark.ml.feature import RegexTokenizer

    filled = df.withColumn("_text", F.coalesce(fold_width(F.col(text)), F.lit("")))
    return RegexTokenizer(inputCol="_text", outputCol=alias, pattern=pattern, gaps=False, toLowercase=True).transform(filled).drop("_text")


def similarity_match(a: DataFrame, b: DataFrame, text: str, id_a: str, id_b: str, threshold: float) -> DataFrame:
    """Pairs of distinct texts with Jaccard distance at most ``threshold`` (below 1), with the number of ids on each side.

    Texts with equal token sets are one representative each, and only the rarest tokens of a set, as many as the threshold
    needs (prefix filter), are joined on, so a token that every text has brings no pairs together.  Columns: ``text_a``,
    ``text_b`` (the least text of each side), ``ids_a``, ``ids_b`` (numbers of ids) and ``distance``.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold must be from 0 to below 1")
    sim = 1 - threshold

    def sets(df: DataFrame, key: str) -> DataFrame:
        listed = df.select(F.col(key).alias("id"), F.col(text).alias("t"), F.array_sort(tokens(F.col(text))).alias("set")).filter("size(set) > 0")
        return listed.groupBy("set").agg(F.min("t").alias("text"), F.count_distinct("id").alias("ids"))

    left, right = sets(a, id_a).withColumn("side", F.lit("a")), sets(b, id_b).withColumn("side", F.lit("b"))
    both = left.unionByName(right).withColumn("rep", F.xxhash64("side", F.to_json("set")))
    each = both.select("rep", F.explode("set").alias("token"))
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(counted, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))  # a text's tokens
    size = F.size("r")
    prefix = F.slice("r", F.lit(1), size - F.ceil(F.lit(sim) * size).cast("int") + 1)
    pieces = ranked.select("rep", size.alias("size"), F.explode(prefix).alias("p")).select("rep", "size", F.col("p.token").alias("token")).join(both.select("rep", "side"), "rep")
    pa, pb = pieces.filter("side = 'a'").select(F.col("rep").alias("rep_a"), F.col("size").alias("n_a"), "token"), pieces.filter("side = 'b'").select(F.col("rep").alias("rep_b"), F.col("size").alias("n_b"), "token")
    pairs = pa.join(pb, "token").filter(F.least("n_a", "n_b") >= sim * F.greatest("n_a", "n_b")).select("rep_a", "rep_b").distinct()
    info = both.select("rep", "set", "text", "ids")
    joined = pairs.join(info.toDF("rep_a", "set_a", "text_a", "ids_a"), "rep_a").join(info.toDF("rep_b", "set_b", "text_b", "ids_b"), "rep_b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    distance = 1 - shared / (F.size("set_a") + F.size("set_b") - shared)
    return joined.withColumn("distance", distance).filter(F.col("distance") <= threshold + 1e-12).select("text_a", "text_b", "ids_a", "ids_b", "distance")


def minhash_match(a: DataFrame, b: DataFrame, text: str, id_a: str, id_b: str, threshold: float, tables: int = 8, features: int = 1 << 18) -> DataFrame:
    """Approximate pairs by MinHash buckets (a subset of the exact ones up to hash collisions)."""
    from pyspark.ml.feature import HashingTF, MinHashLSH

    def vectors(df: DataFrame, key: str) -> DataFrame:
        listed = df.select(F.col(key).alias("id"), tokens(F.col(text)).alias("words")).filter("size(words) > 0")
        distinct = listed.withColumn("_set", F.to_json(F.array_sort("words"))).groupBy("_set").agg(F.min("id").alias("id"), F.first("words").alias("words"))
        return HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True).transform(distinct)

    left, right = vectors(a, id_a), vectors(b, id_b)
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=tables, seed=7).fit(left)
    pairs = model.approxSimilarityJoin(left, right, threshold, distCol="distance")
    return pairs.select(F.col("datasetA.id").alias("id_a"), F.col("datasetB.id").alias("id_b"), "distance")


def with_differences(pairs: DataFrame, a: DataFrame, b: DataFrame, id_a: str, id_b: str, measure_a: str, measure_b: str) -> DataFrame:
    """Pairs with both sides' measure and their absolute difference."""
    left, right = a.select(F.col(id_a).alias("id_a"), F.col(measure_a).alias("measure_a")), b.select(F.col(id_b).alias("id_b"), F.col(measure_b).alias("measure_b"))
    return pairs.join(left, "id_a").join(right, "id_b").withColumn("difference", F.abs(F.col("measure_a") - F.col("measure_b")))
