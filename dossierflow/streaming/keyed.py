"""Keyed state with timers: the leading-edge throttle and runs that stop giving signs of life."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State that no event has touched for so long goes.
IDLE_MS = 3_600_000


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store, which also keeps state beyond memory on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Throttle(StatefulProcessor):
    def __init__(self, key: str, clock: str, gap: float, idle_ms: int):
        self.key, self.clock, self.gap, self.idle_ms = key, clock, gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at double", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([f[self.clock].to_numpy(dtype=float) for f in rows]))
        times = times[~np.isnan(times)]
        last = self.last.get()[0] if self.last.exists() else -math.inf
        late = times[: int(np.searchsorted(times, last))]
        out, at = [], int(np.searchsorted(times, last + self.gap))
        while at < len(times):
            last = float(times[at])
            out.append(last)
            at = max(at + 1, int(np.searchsorted(times, last + self.gap)))
        if last > -math.inf:
            self.last.update((last,))  # any event keeps the key alive
        if out or len(late):
            yield pd.DataFrame({self.key: [key[0]] * (len(out) + len(late)), self.clock: [*out, *late], "late": [False] * len(out) + [True] * len(late)})

    def close(self) -> None:
        pass


def throttle(events: DataFrame, key: str, clock: str, gap: float = 2.0, idle_ms: int = IDLE_MS) -> DataFrame:
    """(key, time, late): an event counts iff `gap` seconds have passed since the last that did.

    Events of a micro-batch are taken in order of time. One that comes in a later batch with an earlier time than the
    last that counted is given out as late and changes nothing. A key is forgotten after `idle_ms` without an event.
    """
    use_rocksdb(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    rows = events.selectExpr(f"`{key}`", f"CAST(`{clock}` AS DOUBLE) AS `{clock}`")
    return rows.groupBy(key).transformWithStateInPandas(_Throttle(key, clock, gap, idle_ms), f"{key} {kind}, {clock} double, late boolean", "append", "ProcessingTime")


class _Runs(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "at double")

    def _disarm(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, status = -math.inf, None
        for frame in rows:
            row = frame.loc[frame["beat_s"].astype(float).idxmax()]
            if float(row["beat_s"]) >= newest:
                newest, status = float(row["beat_s"]), row["status"]
        self._disarm()
        if status == "running":
            self.beat.update((newest,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
            return
        self.beat.clear()
        yield pd.DataFrame({"run": [key[0]], "status": [status], "beat_s": [newest]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.beat.get()[0] if self.beat.exists() else math.nan
        self.beat.clear()
        yield pd.DataFrame({"run": [key[0]], "status": ["interrupted"], "beat_s": [newest]})

    def close(self) -> None:
        pass


def ended_runs(beats: DataFrame, limit_s: float = 300.0) -> DataFrame:
    """(run, status, beat_s) of runs as they end: by their own word, or `interrupted` after `limit_s` without a beat.

    `beats` has run (string), status and beat_s. A run that ended leaves the state; if it beats again it is a new one.
    """
    use_rocksdb(beats.sparkSession)
    rows = beats.selectExpr("CAST(run AS STRING) AS run", "status", "CAST(beat_s AS DOUBLE) AS beat_s").where("beat_s IS NOT NULL")
    return rows.groupBy("run").transformWithStateInPandas(_Runs(int(limit_s * 1000)), "run string, status string, beat_s double", "append", "ProcessingTime")
