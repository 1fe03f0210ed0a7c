"""Items of varying length into containers of fixed capacity.

1. Texts longer than the capacity are cut into full pieces and a rest; nothing else is ever split.
2. The lengths of all pieces form one global histogram (at most ``capacity`` rows, whatever the corpus), and dynamic
   programming over it chooses the bucket boundaries for which padding every piece to its bucket's boundary costs least.
3. Inside each bucket, token-budget batches are formed of the bucket's own pieces alone, each into the tightest batch of its
   bucket that has room.  Buckets go from long to short; the space that the batches of longer buckets have left is offered to
   a bucket's pieces as fillers before they form batches of their own, since a piece longer than half a container would
   otherwise leave the rest of it empty.

Steps 2 and 3 need only the histogram, so the plan is a small table of runs ("pieces of length s with ranks a to b go, k
to a container, to containers from c on"); the corpus is then numbered and joined to it.

Defined results: a null or empty text has no tokens and is put, without using space, into one of the containers in turn;
equal texts are separate items; ties of length are ordered by a hash of the key and the key; an empty table has no
containers.  ``bucket`` is the bucket that formed the container, ``filler`` says that the piece is of a shorter one.
"""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY, BUCKETS = 8192, 16
#: Pieces of one length are numbered in parts of about this many, but in no more than so many parts, so that a length that
#: a third of all pieces has is no single task.
PART, MOST_PARTS = 50_000, 64


def bucket_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least total padding (exact, by dynamic programming).

    A bucket of the sizes i to j pads ``(count_j - count_i) * size_j - (total_j - total_i)``, which is a straight line in
    ``size_j`` for every i, so the best i of all j are read off the lower envelope of these lines in one sweep.
    """
    sizes = sorted(histogram)
    count, total = [0], [0]
    for size in sizes:
        count.append(count[-1] + histogram[size])
        total.append(total[-1] + histogram[size] * size)
    n, k = len(sizes), min(buckets, len(sizes))
    best: list[int | None] = [0] + [None] * n
    origin = np.zeros((k, n + 1), dtype=np.int64)
    for b in range(k):
        fresh: list[int | None] = [0] * (n + 1)
        lines: deque[tuple[int, int, int]] = deque()  # (slope, height, i), slopes falling
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                m3, c3 = -count[j - 1], best[j - 1] + total[j - 1]
                while len(lines) > 1:
                    (m1, c1, _), (m2, c2, _) = lines[-2], lines[-1]
                    if (c3 - c1) * (m1 - m2) > (c2 - c1) * (m1 - m3):
                        break
                    lines.pop()
                lines.append((m3, c3, j - 1))
            x = sizes[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            slope, height, origin[b, j] = lines[0]
            fresh[j] = slope * x + height + count[j] * x - total[j]
        best = fresh
    cuts, j = [], n
    for b in range(k - 1, -1, -1):
        if j:
            cuts.append(sizes[j - 1])
            j = int(origin[b, j])
    return sorted(cuts)


class Spaces:
    """Stretches of containers with equal space left, found by the tightest space that holds a piece."""

    def __init__(self) -> None:
        self.at: dict[int, list[tuple[int, int, int]]] = {}  # space -> (first container, how many, bucket)
        self.sorted: list[int] = []

    def leave(self, space: int, first: int, many: int, bucket: int) -> None:
        if space > 0 and many > 0:
            if space not in self.at:
                bisect.insort(self.sorted, space)
                self.at[space] = []
            self.at[space].append((first, many, bucket))

    def take(self, size: int) -> tuple[int, int, int, int] | None:
        at = bisect.bisect_left(self.sorted, size)
        if at == len(self.sorted):
            return None
        space = self.sorted[at]
        found = self.at[space].pop()
        if not self.at[space]:
            del self.at[space], self.sorted[at]
        return (space, *found)


Run = tuple[int, int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int, edges: list[int]) -> tuple[list[Run], int]:
    """Runs (size, first rank, end rank, first container, pieces a container, bucket of the container), and the number of containers."""
    runs: list[Run] = []
    left, rank = dict(histogram), dict.fromkeys(histogram, 0)
    older, made = Spaces(), 0

    def fill(size: int, space: int, first: int, many: int, bucket: int, back: Spaces) -> None:
        """Pieces of one size into a stretch of containers; what stays open goes back."""
        each = space // size
        full = min(many, left[size] // each)
        for each_now, now in ((each, full), (left[size] - full * each, 1 if full < many else 0)):
            if now and each_now:
                runs.append((size, rank[size], rank[size] + now * each_now, first, each_now, bucket))
                back.leave(space - each_now * size, first, now, bucket)
                rank[size], left[size], first, many = rank[size] + now * each_now, left[size] - now * each_now, first + now, many - now
        back.leave(space, first, many, bucket)

    for bucket in range(len(edges) - 1, -1, -1):
        low = edges[bucket - 1] if bucket else 0
        sizes = sorted((s for s in histogram if low < s <= edges[bucket]), reverse=True)
        for size in sizes:  # fillers of what longer buckets have left
            while left[size] and (found := older.take(size)):
                fill(size, *found, older)
        own = Spaces()
        for size in sizes:
            while left[size]:
                found = own.take(size)
                if not found:
                    many = -(-left[size] // (capacity // size))
                    found, made = (capacity, made, many, bucket), made + many
                fill(size, *found, own)
        for space, stretches in own.at.items():
            for first, many, of in stretches:
                older.leave(space, first, many, of)
    return runs, made


def pack(sized: DataFrame, key: str, tokens: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """One row per piece: key, ``part``, ``tokens``, ``bucket``, ``filler`` and ``container``.

    ``sized`` should be cheap to read twice (written out by the caller).
    """
    spark = sized.sparkSession
    whole = F.floor(F.col(tokens) / capacity).cast("int")
    rest = F.col(tokens) - whole * capacity
    parts = whole + F.when((rest > 0) | (whole == 0), 1).otherwise(0)
    pieces = sized.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), parts), lambda i: F.least(F.lit(capacity).cast("bigint"), F.col(tokens) - (i - 1) * capacity))).alias("part", "size"))
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    slices = {size: min(MOST_PARTS, -(-n // PART)) for size, n in histogram.items()}
    empty = histogram.pop(0, 0)
    edges = bucket_boundaries(histogram, buckets)
    runs, made = plan(histogram, capacity, edges)
    made = max(made, 1 if empty else 0)
    by_size: dict[int, list[tuple]] = {0: [(0, empty, 0, 1, 0)]} if empty else {}
    for size, *run in runs:
        by_size.setdefault(size, []).append(tuple(run))
    # one row for each length, with all of its runs: some 2 * capacity runs in all, whatever the corpus
    steps = spark.createDataFrame(
        [(size, slices[size], bisect.bisect_left(edges, size) if size else 0, found) for size, found in by_size.items()],
        "size bigint, _parts int, _of int, _runs array<struct<_from:bigint,_to:bigint,_first:bigint,_each:bigint,bucket:int>>",
    )
    sliced = pieces.join(F.broadcast(steps), "size").withColumn("_slice", F.pmod(F.xxhash64(key, "part"), F.col("_parts")).cast("int"))
    counted = sliced.filter("_parts > 1").groupBy("size", "_slice").agg(F.count(F.lit(1)).alias("n"))  # at most one row for PART pieces, and MOST_PARTS for a length
    before = F.sum("n").over(Window.partitionBy("size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offset = counted.select("size", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("size", "_slice").orderBy(F.xxhash64(key, "part"), key, "part")
    ranked = sliced.withColumn("_row", F.row_number().over(order) - 1).join(F.broadcast(offset), ["size", "_slice"], "left")
    ranked = ranked.withColumn("_rank", F.col("_row") + F.coalesce("_before", F.lit(0)))
    joined = ranked.withColumn("_run", F.expr("filter(_runs, r -> _rank >= r._from and _rank < r._to)[0]"))
    inside = F.floor((F.col("_rank") - F.col("_run._from")) / F.greatest(F.col("_run._each"), F.lit(1)))
    container = F.when(F.col("size") == 0, F.col("_rank") % made).otherwise(F.col("_run._first") + inside)
    filler = (F.col("size") > 0) & (F.col("_of") < F.col("_run.bucket"))
    return joined.select(key, "part", F.col("size").alias("tokens"), F.col("_run.bucket").alias("bucket"), filler.alias("filler"), container.cast("bigint").alias("container"))
