"""From window scores to alarm events, and their scoring against reference intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from .intervals import merge_intervals, overlap, overlap_join, split_intervals


def durations(scores: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """``(keys, n_windows, duration)``: seconds that the windows of a record cover."""
    return scores.groupBy(*keys).agg(F.count("*").alias("n_windows")).withColumn("duration", (F.col("n_windows") - 1) * cfg.step_s + cfg.window_s)


def alarm_runs(scores: DataFrame, keys: list[str], threshold: float = 0.0, k: int | str = 3) -> DataFrame:
    """``(keys, first_w, last_w, n)``: runs of at least ``k`` windows in a row with a score of ``threshold`` or more.

    ``k`` may be a column's name. Gaps and islands: w less its rank among the hits is constant in a run.
    """
    hit = scores.where(F.col("score") >= threshold)
    order = Window.partitionBy(*keys).orderBy("w")
    least = F.col(k) if isinstance(k, str) else F.lit(k)
    runs = hit.withColumn("island", F.col("w") - F.row_number().over(order)).groupBy(*keys, "island")
    return runs.agg(F.min("w").alias("first_w"), F.max("w").alias("last_w"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def alarm_intervals(runs: DataFrame, lengths: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """``(keys, start, end)`` on the grid of seconds: starts and ends round half to even and stay inside the record."""
    record = [c for c in lengths.columns if c not in ("n_windows", "duration")]
    rows = runs.join(lengths, record)
    end = F.least(F.bround(F.col("last_w") * cfg.step_s + cfg.window_s), F.bround("duration"))
    rows = rows.select(*keys, F.bround(F.col("first_w") * cfg.step_s).alias("start"), end.alias("end")).where("end > start")
    return merge_intervals(rows, keys, 0.0, strict=False)


def arming_times(runs: DataFrame, keys: list[str], k: int = 3, cfg: Config = DEFAULT) -> DataFrame:
    """``(keys, armed)``: the end of the k-th window of each run."""
    return runs.select(*keys, ((F.col("first_w") + k - 1) * cfg.step_s + cfg.window_s).alias("armed"))


def reference_intervals(annotations: DataFrame, lengths: DataFrame, keys: list[str], offset: float = 0.0) -> DataFrame:
    """Annotated intervals on the grid of seconds, clipped to the record; those outside it go."""
    rows = annotations.join(lengths, keys)
    start = F.greatest(F.bround(F.col("start") + offset), F.lit(0.0))
    end = F.least(F.bround(F.col("end") + offset), F.bround("duration"))
    return rows.select(*keys, start.alias("start"), end.alias("end")).where("end > start").distinct()


def scored_events(intervals: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Events as they are scored: merged over short gaps, then split where too long."""
    return split_intervals(merge_intervals(intervals, keys, cfg.merge_gap_s), cfg.max_event_s)


def event_hits(reference: DataFrame, alarms: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """``reference`` with ``hit``: whether an alarm meets the event or its tolerance before and after."""
    meets = overlap_join(reference.select(*keys, "start", "end"), alarms, keys, cfg.after_s, cfg.before_s).select(*keys, "start", "end").distinct().withColumn("hit", F.lit(True))
    return reference.join(meets, [*keys, "start", "end"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def false_alarms(reference: DataFrame, alarms: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Alarms that meet no detected event with its tolerance."""
    found = event_hits(reference, alarms, keys, cfg).where("hit").select(*keys, "start", "end")
    return overlap_join(alarms, found, keys, cfg.before_s, cfg.after_s, how="left_anti")


def event_counts(reference: DataFrame, alarms: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """``(keys, tp, fn, fp)`` of scored events; keys without any event are left out."""
    hits = event_hits(reference, alarms, keys, cfg).select(*keys, F.col("hit").cast("long").alias("tp"), (~F.col("hit")).cast("long").alias("fn"), F.lit(0).cast("long").alias("fp"))
    false = false_alarms(reference, alarms, keys, cfg).select(*keys, F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), F.lit(1).cast("long").alias("fp"))
    return hits.unionByName(false).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp")))


def sample_counts(reference: DataFrame, alarms: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds that both, only alarms, and only references cover: lengths of overlaps of disjoint intervals."""
    ref = merge_intervals(reference, keys, 0.0, strict=False)
    both = overlap_join(alarms, ref, keys).select(*keys, overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")).alias("both"))
    part = lambda df, name: df.select(*keys, *((F.col("end") - F.col("start") if name == c else F.lit(0.0)).alias(c) for c in ("alarm", "ref")), F.lit(0.0).alias("both"))
    rows = part(alarms, "alarm").unionByName(part(ref, "ref")).unionByName(both.select(*keys, F.lit(0.0).alias("alarm"), F.lit(0.0).alias("ref"), "both"))
    sums = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("alarm", "ref", "both")))
    return sums.select(*keys, F.col("both").cast("long").alias("tp"), (F.col("alarm") - F.col("both")).cast("long").alias("fp"), (F.col("ref") - F.col("both")).cast("long").alias("fn"))


def detections(annotations: DataFrame, armed: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Each annotation with ``detected`` and ``latency``: the first arming from ``before_s`` ahead of it to ``after_s`` behind it."""
    a = armed.select(*keys, F.col("armed").alias("start"), F.col("armed").alias("end"))
    inside = overlap_join(a.withColumn("end", F.col("end") + 1e-6).withColumn("start", F.col("start") - 1e-6), annotations.select(*keys, "start", "end").distinct(), keys, cfg.before_s, cfg.after_s)
    first = inside.groupBy(*keys, F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(F.bround(F.min(F.col("start") + 1e-6), 6).alias("armed"))
    rows = annotations.join(first, [*keys, "start", "end"], "left")
    return rows.withColumn("detected", F.col("armed").isNotNull().cast("int")).withColumn("latency", F.col("armed") - F.col("start")).drop("armed")
