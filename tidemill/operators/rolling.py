"""Trailing totals per entity and day with a two-stack queue.

A queue of monoid values made of two stacks gives the aggregate of its content without ever removing a value from an
aggregate, so minimum and maximum work as well as sums.  Here every value of the queue is a vector over all entities of
a batch: all entities move along one calendar, and one push or pop serves them all.

Defined results: an entity has a row for each day from an active day on, days without rows included, until the last day
given (one row, ``last_day``) or until it has been silent for ``idle`` days; it goes on with its next active day.  So an
entity whose clock once said the year 2000 gets that day and the year after it, not a calendar of decades.  Null and NaN amounts count as no amount; averages and extremes over no amount are null; rows without
entity or day are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Monoid = tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], float]

SUM: Monoid = (np.add, 0)
LEAST: Monoid = (np.minimum, np.iinfo(np.int64).max)
MOST: Monoid = (np.maximum, np.iinfo(np.int64).min)


class TwoStackQueue:
    """A first-in first-out queue that knows the aggregate of its content at all times."""

    def __init__(self, monoid: Monoid, shape: int) -> None:
        self.join, unit = monoid
        self.unit = np.full(shape, unit, dtype=np.int64)
        self.back: list[np.ndarray] = []
        self.back_total = self.unit
        self.front: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.back) + len(self.front)

    def push(self, value: np.ndarray) -> None:
        self.back.append(value)
        self.back_total = self.join(self.back_total, value)

    def pop(self) -> None:
        if not self.front:
            total = self.unit
            while self.back:
                total = self.join(self.back.pop(), total)
                self.front.append(total)
            self.back_total = self.unit
        self.front.pop()

    def total(self) -> np.ndarray:
        return self.join(self.front[-1], self.back_total) if self.front else self.back_total


def trailing(values: np.ndarray, length: int, monoid: Monoid) -> np.ndarray:
    """Aggregate over the last ``length`` columns at every column of an entity x day matrix."""
    queue, out = TwoStackQueue(monoid, values.shape[0]), np.empty_like(values)
    for day in range(values.shape[1]):
        queue.push(values[:, day])
        if len(queue) > length:
            queue.pop()
        out[:, day] = queue.total()
    return out


#: Entities taken from a partition at once, and cells (stretches of activity times days) of one matrix; together they bound
#: the memory of a task whatever a partition holds.
ENTITIES_AT_ONCE, CELLS = 2048, 1 << 19
#: Days without activity after which an entity's calendar ends.
IDLE = 366


def rolling_totals(rows: DataFrame, key: str, day: str, cents: str, last_day: DataFrame, windows: tuple[int, ...] = (7, 30), idle: int = IDLE) -> DataFrame:
    """Per key and day: for each window length w ``sum_w``, ``avg_w`` (per amount), ``min_w``, ``max_w``, ``orders_w``.

    ``cents`` is a bigint column, null where there is no amount; days after ``last_day`` are left out.  One shuffle: rows are first reduced to one per key and
    day (so a key with a third of all rows arrives as a few days), then sorted by key and day inside their partition.
    """
    daily = (
        rows.filter(F.col(key).isNotNull() & F.col(day).isNotNull())
        .groupBy(key, day)
        .agg(F.sum(cents).alias("_sum"), F.count(cents).alias("_n"), F.min(cents).alias("_min"), F.max(cents).alias("_max"))
        .select(key, F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("_day"), "_sum", "_n", "_min", "_max")
    )
    last = last_day.toDF("_last_day").select(F.datediff("_last_day", F.lit("1970-01-01").cast("date")).alias("_last"))
    daily = daily.join(F.broadcast(last), F.col("_day") <= F.col("_last"))  # an aggregate: one row
    kind = dict(rows.dtypes)[key]
    fields = ", ".join(f"sum_{w} double, avg_{w} double, min_{w} double, max_{w} double, orders_{w} bigint" for w in windows)

    if idle < max(windows):
        raise ValueError("a calendar may only end when all windows are empty")

    def matrices(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """All days of some entities, sorted by key and day: a row of a matrix is a stretch of activity, from its own start."""
        ids, days, last = part[key].to_numpy(), part["_day"].to_numpy().astype(np.int64), int(part["_last"].iloc[0])
        fresh = np.ones(len(part), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (np.diff(days) > idle)
        at = np.flatnonzero(fresh)
        ends = np.minimum(days[np.append(at[1:], len(part)) - 1] + idle, last)
        nearer = np.append(ids[at][1:] == ids[at][:-1], False)  # the next stretch is of the same entity
        ends[nearer] = np.minimum(ends[nearer], days[np.append(at[1:], at[-1])][nearer] - 1)
        widths = ends - days[at] + 1
        low = 0
        while low < len(at):
            high, widest = low, 0
            while high < len(at) and (high == low or (high + 1 - low) * max(widest, widths[high]) <= CELLS):
                widest = max(widest, widths[high])
                high += 1
            stop = at[high] if high < len(at) else len(part)
            yield matrix(part.iloc[at[low] : stop], fresh[at[low] : stop].cumsum() - 1, days[at[low:high]], widths[low:high])
            low = high

    def matrix(part: pd.DataFrame, row: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> pd.DataFrame:
        shape = (len(starts), int(widths.max()))
        col = part["_day"].to_numpy() - starts[row]

        def dense(name: str, unit: float) -> np.ndarray:
            out = np.full(shape, unit, dtype=np.int64)
            given = part[name].notna().to_numpy()
            out[row[given], col[given]] = part[name].to_numpy()[given].astype(np.int64)
            return out

        live = np.arange(shape[1])[None, :] < widths[:, None]
        r, c = np.nonzero(live)
        ids = part[key].to_numpy()[np.searchsorted(row, np.arange(len(starts)))]
        out = {key: ids[r], day: (c + starts[r]).astype("datetime64[D]")}
        sums, counts, least, most = dense("_sum", 0), dense("_n", 0), dense("_min", LEAST[1]), dense("_max", MOST[1])
        for w in windows:
            n = trailing(counts, w, SUM)[live]
            s = trailing(sums, w, SUM)[live] / 100.0
            with np.errstate(all="ignore"):
                out[f"sum_{w}"] = s
                out[f"avg_{w}"] = pd.Series(np.where(n > 0, s / n, 0.0)).mask(n == 0)
                out[f"min_{w}"] = pd.Series(trailing(least, w, LEAST)[live] / 100.0).mask(n == 0)
                out[f"max_{w}"] = pd.Series(trailing(most, w, MOST)[live] / 100.0).mask(n == 0)
            out[f"orders_{w}"] = n
        return pd.DataFrame(out)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            while held[key].nunique() > ENTITIES_AT_ONCE:
                cut = int(np.searchsorted(held[key].to_numpy(), held[key].unique()[ENTITIES_AT_ONCE]))
                yield from matrices(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield from matrices(held)

    ordered = daily.repartition(F.col(key)).sortWithinPartitions(key, "_day")
    return ordered.mapInPandas(run, f"{key} {kind}, {day} date, {fields}")
