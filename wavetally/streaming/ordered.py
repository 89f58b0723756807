"""Alarms from a stream whose windows come in any order: a record's windows wait until they can be taken in their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .alarms import ARMED


class OrderedRuns(StatefulProcessor):
    """A record's state: its last window, the run length there and its time, and the windows that wait.

    A window that follows the last one is taken at once. One beyond a gap waits until the watermark has passed its time, as what is missing may
    still come; then the gap ends the run. A window before the last one comes too late. When the watermark has passed a record's last time by
    ``idle_ms``, nothing waits any more, and its state goes.
    """

    def __init__(self, threshold: float, k: int, idle_ms: int):
        self.threshold, self.k, self.idle_ms = threshold, k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last long, run long, ms long")
        self.waiting = handle.getMapState("waiting", "w long", "ms long, score double")

    def _taken(self, upto_ms: int) -> list[tuple[int, int]]:
        """``(w, ms)`` at which runs reach their length, of the windows that may be taken now."""
        last, run, seen = self.place.get() if self.place.exists() else (-1, 0, 0)
        out, rows = [], sorted((int(w[0]), int(v[0]), float(v[1])) for w, v in self.waiting.iterator())
        for w, ms, score in rows:
            if w > last + 1 and ms > upto_ms:
                break
            self.waiting.removeKey((w,))
            if w > last:
                run = (run if w == last + 1 else 0) + 1 if score >= self.threshold else 0
                last, seen = w, max(seen, ms)
                if run == self.k:
                    out.append((w, ms))
        self.place.update((last, run, seen))
        return out

    def _rows(self, key: tuple, armed: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"record": [key[0]] * len(armed), "w": [w for w, _ in armed], "armed_at": pd.to_datetime([ms for _, ms in armed], unit="ms")}).astype({"record": object, "w": "int64", "armed_at": "datetime64[ns]"})

    def _wake(self, ms: int) -> None:
        if ms not in set(self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.place.get()[0] if self.place.exists() else -1
        newest = 0
        for pdf in rows:
            for w, ms, score in zip(pdf["w"], pdf["ms"], pdf["score"]):
                newest = max(newest, int(ms))
                if w > last and not self.waiting.containsKey((int(w),)):  # of a window that comes twice, the first counts
                    self.waiting.updateValue((int(w),), (int(ms), float(score)))
        armed = self._taken(timerValues.getCurrentWatermarkInMs())
        for _, v in list(self.waiting.iterator()):
            self._wake(int(v[0]))
        self._wake(newest + self.idle_ms)
        yield self._rows(key, armed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        armed = self._taken(expiredTimerInfo.getExpiryTimeInMs())
        _, _, seen = self.place.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= seen + self.idle_ms and not any(True for _ in self.waiting.iterator()):
            self.place.clear()
            self.waiting.clear()
        yield self._rows(key, armed)

    def close(self) -> None:
        pass


def ordered_arming_stream(scores: DataFrame, threshold: float = 0.0, k: int = 3, late: str = "10 minutes", idle_s: float = 3600.0) -> DataFrame:
    """``(record, w, armed_at)`` at the k-th window in a row at or above ``threshold``, whatever order ``scores(record, w, ts, score)`` come in.

    The result is that of the windows in their order, as long as none is later than the watermark ``late``; see :class:`OrderedRuns`. A
    state store that keeps several columns of state is needed: ``spark.sql.streaming.stateStore.providerClass`` of RocksDB.
    """
    rows = scores.withWatermark("ts", late).select(F.col("record").cast("string").alias("record"), "w", "ts", F.unix_millis("ts").alias("ms"), "score")
    return rows.groupBy("record").transformWithStateInPandas(OrderedRuns(threshold, k, int(idle_s * 1000)), ARMED, "append", "eventTime")
