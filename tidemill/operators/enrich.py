"""Enrichment by a rate-limited external service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class Busy(Exception):
    """The service asks to wait; ``after`` says how many seconds."""

    def __init__(self, after: float = 1.0) -> None:
        super().__init__(f"retry after {after} s")
        self.after = after


class Bucket:
    """Tokens that refill every second."""

    def __init__(self, rate: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.clock, self.sleep = max(1, rate), clock, sleep
        self.left, self.since = self.rate, clock()

    def take(self) -> None:
        while True:
            now = self.clock()
            if now - self.since >= 1:
                self.left, self.since = self.rate, now
            if self.left:
                self.left -= 1
                return
            self.sleep(max(0.0, 1 - (now - self.since)))


def worker_rate(cluster: int, parallelism: int, safety: float = 0.5, most: int = 10) -> int:
    """Calls a second of one worker out of a cluster's limit."""
    return max(1, min(most, int(cluster / max(1, parallelism) * safety)))


class Counts:
    """Accumulators of calls, and of the rows that succeeded and failed.

    They are exact if no task is repeated; a task that is run again counts its calls again, as it makes them again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.calls, self.success, self.fail = (spark.sparkContext.accumulator(0) for _ in range(3))

    def values(self) -> dict[str, int]:
        return {"calls": self.calls.value, "success": self.success.value, "fail": self.fail.value}


def backoff(attempt: int, base: float, most: float = 30.0) -> float:
    """Seconds to wait after a failed attempt, doubling from ``base``."""
    return min(most, base * 2**attempt)


def api_enrich(
    df: DataFrame, key: str, client: Callable[[list], dict], schema: str, chunk: int = 20, rate: int = 10, max_attempts: int = 1, dead: dict | None = None,
    counts: Counts | None = None, wait: float = 0.5,
) -> DataFrame:
    """Rows of ``schema`` (key first, boolean ``_dlq`` last) for every row of ``df``.

    ``client`` takes a list of rows (dicts) and returns values by key.  Each worker calls it for ``chunk`` rows at a time
    within its rate; a busy service is waited for as long as it says, any other failure ``wait`` seconds and twice as long
    each time after, and after ``max_attempts`` failures the chunk's rows come out with ``_dlq`` true and the values of
    ``dead``.  ``counts`` are added to as the result is computed.  The schema is declared, so no job runs ahead to infer it; write
    the result once and read it back, or the calls are repeated with the lineage.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Bucket(rate)
        for part in parts:
            out = []
            rows = part.to_dict("records")
            for at in range(0, len(rows), chunk):
                some, found = rows[at : at + chunk], None
                for attempt in range(max_attempts):
                    bucket.take()
                    if counts:
                        counts.calls.add(1)
                    try:
                        found = client(some)
                        break
                    except Busy as busy:
                        time.sleep(busy.after)
                    except Exception:  # noqa: BLE001
                        if attempt + 1 < max_attempts:
                            time.sleep(backoff(attempt, wait))
                for row in some:
                    value = (found or {}).get(row[key])
                    values = value if value is not None else (dead or {})
                    if counts:
                        (counts.success if value is not None else counts.fail).add(1)
                    out.append([row[key], *(values.get(n) for n in names[1:-1]), value is None])
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)
