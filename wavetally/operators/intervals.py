"""Intervals on a line: merging, splitting and overlap, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_intervals(df: DataFrame, keys: list[str], gap: float = 0.0, strict: bool = True) -> DataFrame:
    """Union of the ``(start, end)`` intervals of each key, joined where less than ``gap`` lies between.

    With ``strict`` off, a distance of exactly ``gap`` joins as well. One shuffle by the keys.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("start") - F.col("reach") >= gap) if strict else (F.col("start") - F.col("reach") > gap)
    rows = df.select(*keys, "start", "end").withColumn("reach", reach)
    rows = rows.withColumn("group", F.sum(F.when(F.col("reach").isNull() | apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("group")


def split_intervals(df: DataFrame, longest: float) -> DataFrame:
    """Intervals cut into pieces of at most ``longest``; other columns repeat."""
    others = [c for c in df.columns if c not in ("start", "end")]
    pieces = F.greatest(F.ceil((F.col("end") - F.col("start")) / longest), F.lit(1)).cast("int")
    rows = df.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("start") + F.col("piece") * longest
    return rows.select(*others, start.alias("start"), F.least(start + longest, F.col("end")).alias("end"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], before: float = 0.0, after: float = 0.0, how: str = "inner", cell: float = 600.0) -> DataFrame:
    """Pairs whose left interval meets ``(start - before, end + after)`` of the right one, strictly.

    An equality join on the keys and on cells of time, so that a long record does not meet in one
    task; a pair that shares several cells is kept in its first common one. Right columns
    come as ``r_*``. ``how`` is inner, left_semi or left_anti.
    """
    r = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    lo, hi = F.floor((F.col("r_start") - before) / cell), F.floor((F.col("r_end") + after) / cell)
    r = r.withColumn("lo_r", lo).withColumn("cell", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    lo_l, hi_l = F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)
    meets = (F.col("start") < F.col("r_end") + after) & (F.col("end") > F.col("r_start") - before)
    rows = left.withColumn("lo_l", lo_l).withColumn("cell", F.explode(F.sequence(lo_l, F.greatest(lo_l, hi_l))))
    pairs = rows.join(r, [*keys, "cell"]).where(meets & (F.col("cell") == F.greatest("lo_l", "lo_r"))).drop("cell", "lo_l", "lo_r")
    if how == "inner":
        return pairs
    hit = pairs.select(*left.columns).distinct()
    on = [left[c].eqNullSafe(hit[c]) for c in left.columns]
    return left.join(hit, on, how)
