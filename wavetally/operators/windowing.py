"""Sliding windows over recordings: generation, membership, labels and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from .intervals import overlap, overlap_join


def sliding_windows(records: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """``(keys, w, start, stop)`` in samples, from ``n_samples`` of each record; an incomplete tail has no window."""
    n = F.floor((F.col("n_samples") - cfg.window) / cfg.step) + 1
    rows = records.where(F.col("n_samples") >= cfg.window).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("w"))
    return rows.select(*keys, "w", (F.col("w") * cfg.step).alias("start"), (F.col("w") * cfg.step + cfg.window).alias("stop"))


def windows_of_sample(sample: Column, n_windows: Column, window: int, step: int) -> Column:
    """The windows that hold a sample, by arithmetic: no range join."""
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((sample - window + 1) / step))
    hi = F.least(n_windows - 1, F.floor(sample / step))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def demeaned(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` less its mean per key, such as a window's channel; the means are joined back, so that no key's rows need meet in one task."""
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return rows.join(mean, keys).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def label_windows(windows: DataFrame, reference: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """``(keys, w, seconds, label)``: 1 where disjoint reference intervals cover at least the labelled share of a window."""
    spans = windows.withColumn("start", F.col("w") * cfg.step_s).withColumn("end", F.col("w") * cfg.step_s + cfg.window_s)
    part = overlap_join(spans, reference, keys).select(*keys, "w", overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")).alias("seconds"))
    rows = part.unionByName(windows.select(*keys, "w", F.lit(0.0).alias("seconds")))
    sums = rows.groupBy(*keys, "w").agg(F.sum("seconds").alias("seconds"))
    return sums.withColumn("label", (F.col("seconds") / cfg.window_s >= cfg.label_share).cast("int"))


def vector_statistics(vector: Column) -> dict[str, Column]:
    """Smallest, largest, and the numbers of missing and zero values of a feature vector."""
    return {
        "least": F.array_min(vector),
        "most": F.array_max(vector),
        "n_nan": F.size(F.filter(vector, lambda x: F.isnan(x) | x.isNull())).cast("long"),
        "n_zero": F.size(F.filter(vector, lambda x: x == 0)).cast("long"),
    }


def band_trapezoid(points: DataFrame, keys: list[str], bands: DataFrame) -> DataFrame:
    """``(keys, band, value)``: trapezoid over the points ``(freq, v)`` in each closed band, over the band's width.

    Points come in order of frequency per key; ``bands(band, lo, hi)`` is a small dimension.
    """
    rows = points.join(F.broadcast(bands), F.col("freq").between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy(*keys, "band").orderBy("freq")
    area = (F.lead("freq").over(order) - F.col("freq")) * (F.lead("v").over(order) + F.col("v")) / 2
    return rows.withColumn("area", area).groupBy(*keys, "band").agg((F.sum("area") / F.first(F.col("hi") - F.col("lo"))).alias("value"))
