"""Alarms from a stream of window scores: run lengths kept per record, and alarms joined into sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ARMED = "record string, w long, armed_at timestamp"


def arming_stream(scores: DataFrame, threshold: float = 0.0, k: int = 3, late: str = "10 minutes") -> DataFrame:
    """``(record, w, armed_at)`` at the k-th window in a row at or above ``threshold``.

    ``scores(record, w, ts, score)`` is a stream; a record's state is its last window and run
    length. Within a batch, windows are taken in order; one that comes after a later one was seen is dropped.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (-1, 0)
        out = []
        for w, ts, score in sorted((r for pdf in pdfs for r in zip(pdf["w"], pdf["ts"], pdf["score"])), key=lambda r: r[0]):
            if w <= last:
                continue
            run = (run + 1 if w == last + 1 or run == 0 else 1) if score >= threshold else 0
            last = w
            if run == k:
                out.append((key[0], w, ts))
        state.update((int(last), int(run)))
        yield pd.DataFrame(out, columns=["record", "w", "armed_at"])

    keyed = scores.withWatermark("ts", late).select(F.col("record").cast("string").alias("record"), "w", "ts", "score").groupBy("record")
    return keyed.applyInPandasWithState(step, ARMED, "last long, run long", "append", GroupStateTimeout.NoTimeout)


def alarm_sessions(alarms: DataFrame, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """``(record, start, end, n)``: alarms of a stream joined over gaps shorter than ``gap``."""
    s = alarms.withWatermark("ts", late).groupBy("record", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("record", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def sliding_rates(scores: DataFrame, width: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean score per sliding window of a stream."""
    return scores.withWatermark("ts", late).groupBy("record", F.window("ts", width, step).alias("win")).agg(F.avg("score").alias("mean"), F.count("*").alias("n")).select("record", F.col("win.start").alias("start"), "mean", "n")
