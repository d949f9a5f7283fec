"""Leases of work items, kept as state: a heartbeat renews its item's lease, silence gives the item back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASED = "item string, worker string, released_us long"


class _Leases(StatefulProcessor):
    """State of an item: its last heartbeat (microseconds) and who sent it. A timer stands at the end of the lease."""

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker string, at long")

    def _given_back(self, item: str, released: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if released:
            yield pd.DataFrame({"item": [item] * len(released), "worker": [w for w, _ in released], "released_us": [t for _, t in released]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beats = pd.concat(list(rows), ignore_index=True).sort_values(["at", "worker"], kind="stable")
        worker, last = self.lease.get() if self.lease.exists() else (None, None)
        if last is not None:
            self.handle.deleteTimer((last + self.timeout) // 1000 + 1)
        released = []
        for w, at in zip(beats["worker"].tolist(), beats["at"].tolist(), strict=True):
            if last is not None and at - last > self.timeout:
                released.append((worker, last + self.timeout))
            if last is None or at >= last:  # a beat that comes late renews nothing
                worker, last = w, at
        self.lease.update((worker, last))
        self.handle.registerTimer((last + self.timeout) // 1000 + 1)
        yield from self._given_back(key[0], released)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lease.exists():
            worker, last = self.lease.get()
            self.lease.clear()
            yield from self._given_back(key[0], [(worker, last + self.timeout)])

    def close(self) -> None:
        pass


def releases(beats: DataFrame, item: str, worker: str, ts: str, timeout_seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """(item, worker, released_at) of a stream of heartbeats: items whose worker was silent for longer than the timeout, when it ended, also if another beat came later.

    What is known of an item is one row of state, whatever its number of beats; a lease ends by a timer once the watermark (the latest beat less ``late``) has
    passed it, without any further beat of the item. Beats without an item or a time are left out.
    """
    b = beats.withWatermark(ts, late).filter(F.col(item).isNotNull() & F.col(ts).isNotNull())
    b = b.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(worker).cast("string"), F.lit("")).alias("worker"), F.col(ts), F.unix_micros(ts).alias("at"))
    r = b.groupBy("item").transformWithStateInPandas(statefulProcessor=_Leases(timeout_seconds * 1_000_000), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")
    return r.select("item", "worker", F.timestamp_micros("released_us").alias("released_at"))
