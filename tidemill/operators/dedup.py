"""Exactly one copy of every message of an at-least-once feed.

Identifiers come in two kinds.  ``<producer><separator><number>`` is a producer sequence: what has been seen is a set of
disjoint ranges per producer, so the state of a producer that counts without gaps is one row however long it runs.
Everything else (UUIDs here, in any of their usual spellings) has no order to build ranges from and is resolved by an
exact keyed lookup.  ``accept`` takes one batch against that state, ``accept_all`` a whole table as batches in order.

Defined results: a null or blank identifier is a message of its own and always kept; of equal identifiers the row with
the smallest order columns is kept, a null order value coming last; rows equal in every column are told apart by the row
id, which must be unique; separator and leading zeros of a sequence belong to its producer (``p-12``, ``p#12`` and ``p-012``
are three messages); further columns are carried through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Numbers of one producer are handled in blocks of this size, so that a producer with a third of all rows is spread
#: over many tasks.
BLOCK = 1 << 16

_WIDE = "０１２３４５６７８９ａｂｃｄｅｆＡＢＣＤＥＦ－｛｝：　"
_NARROW = "0123456789abcdefABCDEF-{}: "

RANGES = "producer string, lo bigint, hi bigint"
KEYS = "message_key binary"


def message_id(raw: Column) -> Column:
    """A struct of ``key`` (binary; null: a message of its own), and ``producer`` and ``seq`` (null unless a sequence).

    A UUID's key is its 16 bytes: braces, ``urn:uuid:``, hyphens, blanks, width and case do not matter.  The usual
    spelling is recognised without regular expressions; only the rest is parsed.
    """
    none = (F.lit(None).cast("string").alias("producer"), F.lit(None).cast("bigint").alias("seq"))
    plain = F.try_to_binary(F.replace(raw, F.lit("-")), F.lit("hex"))
    text = F.trim(F.regexp_replace(F.translate(raw, _WIDE, _NARROW), r"[\s\x{00A0}]+", " "))
    digits = F.regexp_replace(F.lower(text), r"^urn:uuid:|[{}\- ]", "")
    parts = r"(?s)^(.*[^0-9]0*?)(0|[1-9][0-9]*)$"
    is_seq = text.rlike("[^0-9 ].*[-_:/#][0-9]{1,18}$")
    other = F.encode(F.when(F.length(text) > 0, F.concat(F.lit("identifier in no known form: "), text)), "utf-8")
    parsed = (
        F.when(digits.rlike("^[0-9a-f]{32}$"), F.struct(F.unhex(digits).alias("key"), *none))
        .when(is_seq, F.struct(F.lit(None).cast("binary").alias("key"), F.regexp_extract(text, parts, 1).alias("producer"), F.regexp_extract(text, parts, 2).cast("bigint").alias("seq")))
        .otherwise(F.struct(other.alias("key"), *none))
    )
    return F.when((F.length(raw) == 36) & (F.octet_length(plain) == 16), F.struct(plain.alias("key"), *none)).otherwise(parsed)


def _in_blocks(ranges: DataFrame) -> DataFrame:
    """Ranges cut at the borders of blocks; as a range holds accepted numbers only, there are few cuts for many messages."""
    each = ranges.select("producer", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))).alias("block"))
    return each.select("producer", "block", F.greatest("lo", F.col("block") * BLOCK).alias("lo"), F.least("hi", F.col("block") * BLOCK + BLOCK - 1).alias("hi"))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """The same covered numbers as the fewest disjoint ranges per producer (overlap and adjacency merge).

    Ranges are merged inside blocks first; only those that end at a border, at most two a block, are merged by producer.
    """
    by = Window.partitionBy("producer", "block").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach >= F.col("lo") - 1, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    inside = _in_blocks(ranges).withColumn("_island", island).groupBy("producer", "block", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    border = (F.col("lo") == F.col("block") * BLOCK) | (F.col("hi") == F.col("block") * BLOCK + BLOCK - 1)
    along = Window.partitionBy("producer").orderBy("lo")
    edges = inside.filter(border).withColumn("_joined", F.lag("hi").over(along) == F.col("lo") - 1)
    run = F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    merged = edges.withColumn("_run", run).groupBy("producer", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return inside.filter(~border).select("producer", "lo", "hi").unionByName(merged.select("producer", "lo", "hi"))


def _order(rows: DataFrame, order_col: str, row_id: str) -> Column:
    """One value that sorts as (order column with nulls last, row id).

    Of a timestamp and an integer it is a single decimal, which hash aggregation can update in place; of other types a
    struct.
    """
    kinds = dict(rows.dtypes)
    if kinds[order_col] in ("timestamp", "timestamp_ntz") and kinds[row_id] in ("int", "bigint"):
        micros = F.coalesce(F.unix_micros(F.col(order_col).cast("timestamp")), F.lit(2**62)).cast("decimal(19,0)")
        return (micros * F.lit(10**18).cast("decimal(19,0)") + F.col(row_id).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(F.col(order_col).isNull().alias("late"), F.col(order_col).alias("t"), F.col(row_id).alias("id"))


def covered(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Those (producer, block, seq) that lie in a seen range; one sorted sweep per block instead of a range join."""
    marks = _in_blocks(ranges).select("producer", "block", F.col("lo").alias("seq"), "hi", F.lit(0).alias("_kind"))
    asked = numbers.select("producer", "block", "seq", F.lit(None).cast("bigint").alias("hi"), F.lit(1).alias("_kind"))
    sweep = Window.partitionBy("producer", "block").orderBy("seq", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.unionByName(asked)
        .withColumn("_reach", F.max("hi").over(sweep))
        .filter("_kind = 1 and _reach >= seq")
        .select("producer", "block", "seq")
    )


def identified(rows: DataFrame, id_col: str, order_col: str, row_id: str) -> DataFrame:
    """The rows' columns as ``_row`` (so that none can clash), with ``_mid`` (see message_id), ``_at`` (their order) and
    ``_key``, which no two messages share.

    A row without identifier gets a key of its own, so such rows spread over all tasks like any other.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "kept")).alias("_row")
    rows = rows.select(whole, message_id(F.col(id_col)).alias("_mid"), _order(rows, order_col, row_id).alias("_at"), F.col(row_id).cast("string").alias("_id"))
    sequence = F.encode(F.concat(F.lit("sequence: "), F.col("_mid.seq").cast("string"), F.lit(" of "), F.col("_mid.producer")), "utf-8")
    lone = F.encode(F.concat(F.lit("message of its own: "), F.coalesce("_id", F.lit("null"))), "utf-8")
    return rows.withColumn("_key", F.coalesce("_mid.key", sequence, lone)).drop("_id")


def _mark(rows: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """``kept`` for identified rows, false for all rows of a refused ``_key``.

    The first row of a key is found by an aggregate that combines before its shuffle, and marked by a join on its order
    value, which no two rows share; so a key with a third of all rows is gathered nowhere.
    """
    first = rows.groupBy("_key").agg(F.min("_at").alias("_first"))
    if refused is not None:
        first = first.join(refused.select("_key"), "_key", "left_anti")
    joined = rows.join(first.select("_first", F.lit(True).alias("_hit")), F.col("_at") == F.col("_first"), "left")
    return joined.withColumn("kept", F.col("_hit").isNotNull())


def mark_duplicates(rows: DataFrame, id_col: str, order_col: str, row_id: str) -> DataFrame:
    """All rows with a boolean ``kept`` (in place of a column of that name), true for exactly one row of each message."""
    return _mark(identified(rows, id_col, order_col, row_id).drop("_mid")).select("_row.*", "kept")


def accept(batch: DataFrame, id_col: str, order_col: str, row_id: str, seen_ranges: DataFrame, seen_keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch against what was seen: (its rows with ``kept``, the ranges seen from now on, the keys that are new)."""
    return _accept(materialize(identified(batch, id_col, order_col, row_id), "p6-rows"), seen_ranges, seen_keys)


def _accept(rows: DataFrame, seen_ranges: DataFrame, seen_keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    counted = rows.filter("_mid.producer is not null")
    refused = rows.filter("_mid.key is not null").select("_key").distinct().join(seen_keys.toDF("_key"), "_key", "left_semi")
    sequences = not counted.isEmpty()
    if sequences:
        block = F.floor(F.col("_mid.seq") / BLOCK).cast("bigint")
        numbers = counted.select(F.col("_mid.producer").alias("producer"), block.alias("block"), F.col("_mid.seq").alias("seq"), "_key").distinct()
        refused = refused.unionByName(covered(numbers, seen_ranges).join(numbers, ["producer", "block", "seq"]).select("_key"))
    marked = materialize(_mark(rows, refused).select("_row", "kept", "_key", "_mid.producer", "_mid.seq", F.col("_mid.key").isNotNull().alias("_keyed")), "p6-batch")
    new, ranges = marked.filter("kept"), seen_ranges
    if sequences:
        fresh = new.filter("producer is not null").select("producer", F.col("seq").alias("lo"), F.col("seq").alias("hi"))
        ranges = materialize(merge_ranges(seen_ranges.unionByName(fresh)), "p6-ranges")
    return marked.select("_row.*", "kept"), ranges, new.filter("_keyed").select(F.col("_key").alias("message_key"))


def accept_all(rows: DataFrame, id_col: str, order_col: str, row_id: str, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """A whole table taken as ``batches`` batches of equal spans of the (timestamp) order column: (rows with ``kept``, ranges).

    As batches go in the order of what decides between copies, the result does not depend on their number.  Rows without
    order value come last.  The rows are laid out by batch once, so each batch reads its own part only.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(order_col), F.max(order_col)).first()
    at, kind = F.col(order_col), dict(rows.dtypes)[order_col]
    edges = [low + (high - low) * n / batches for n in range(1, batches)] if low is not None and high > low else []
    number = F.when(at.isNull(), len(edges)).otherwise(sum(((at >= F.lit(e).cast(kind)).cast("int") for e in edges), F.lit(0)))
    known = identified(rows.withColumn("_call", number), id_col, order_col, row_id)
    known = known.select(F.col("_row").dropFields("_call").alias("_row"), "_mid", "_at", "_key", F.col("_row._call").alias("_call"))
    parts = materialize(known, "p6-rows", partition_by=["_call"])
    ranges, keys, out = spark.createDataFrame([], RANGES), [spark.createDataFrame([], KEYS)], []
    for call in range(len(edges) + 1):
        marked, ranges, fresh = _accept(parts.filter(F.col("_call") == call).drop("_call"), ranges, reduce(DataFrame.unionByName, keys))
        keys.append(fresh)
        out.append(marked)
    discard(parts)
    return reduce(DataFrame.unionByName, out), ranges
