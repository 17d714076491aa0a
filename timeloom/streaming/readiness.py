"""The same decision on a stream of polls: one small state a path, with timers.

A path that nobody polls again still runs out of time: its timer fires. Polls of a path count in order of
t; one that is older than the last seen is ignored, whichever micro-batch brings it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "path string, status string, at double, size_bytes long"
_OPEN = "began double, since double, size_bytes long, mtime_ns long, last double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Watch(StatefulProcessor):
    """open: what is known of a path that isn't decided; done: decided, kept for a while so that it isn't told twice."""

    def __init__(self, stable_for: float, timeout: float, keep_done: float):
        self.stable_for, self.timeout, self.keep_done = stable_for, timeout, keep_done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.done = handle.getValueState("done", "at double", ttlDurationMs=max(1, int(self.keep_done * 1000)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values("t", kind="stable")
        if self.done.exists():
            self.done.update((float(polls["t"].iloc[-1]),))  # its time to live starts anew
            return
        began, since, size, mtime, last = self.open.get() if self.open.exists() else (None,) * 5
        for t, n, m in zip(polls["t"].astype(float), polls["size_bytes"], polls["mtime_ns"], strict=True):
            if last is not None and t < last:
                continue
            began, last = t if began is None else began, t
            n = None if pd.isna(n) or n <= 0 else int(n)
            m = None if pd.isna(m) else int(m)
            if n is None:
                since = size = mtime = None
            elif (n, m) != (size, mtime) or since is None:
                since, size, mtime = t, n, m
            if since is not None and t - since >= self.stable_for:
                yield self._decided(key, "ready", t, size)
                return
            if t - began >= self.timeout:
                yield self._decided(key, "timeout", t, None)
                return
        self.open.update((began, since, size, mtime, last))
        self._forget_timers()
        left = self.timeout - (last - began)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(left * 1000)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield self._decided(key, "timeout", self.open.get()[0] + self.timeout, None)

    def _decided(self, key, status: str, at: float, size: int | None) -> pd.DataFrame:
        self.open.clear()
        self._forget_timers()
        self.done.update((at,))
        return pd.DataFrame({"path": [key[0]], "status": [status], "at": [at], "size_bytes": pd.array([size], dtype="Int64")})

    def _forget_timers(self) -> None:
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def watch(polls: DataFrame, stable_for: float = 2.0, timeout: float = 900.0, keep_done: float = 3600.0) -> DataFrame:
    """polls: a stream (path, t in seconds, size_bytes, mtime_ns). Emits a path once, when it is ready or has run out of
    time: by its polls, or when the processing clock says that no poll will come in time. That a path is done is
    kept for `keep_done` seconds after its last poll; polls later than that would start it anew. As timers may always
    come, the query runs until it is stopped, whatever its trigger. They need the RocksDB state store, which is
    set for the session."""
    polls.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return polls.groupBy("path").transformWithStateInPandas(_Watch(stable_for, timeout, keep_done), OUT, "append", "processingTime")
