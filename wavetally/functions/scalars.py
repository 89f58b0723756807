"""Scalar expressions: guarded ratios, names, units and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def guarded_ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where b is zero."""
    return F.try_divide(a, b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """``a / b``, 0.0 where b is zero."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def nan_to_null(c: Column) -> Column:
    """Missing values come as NaN from files; Spark orders NaN above all numbers, so they become null."""
    return F.when(~F.isnan(c), c)


def normalise_name(c: Column) -> Column:
    """Upper case, no blanks, and no numeric suffix behind a hyphen."""
    return F.regexp_replace(F.replace(F.trim(F.upper(c)), F.lit(" "), F.lit("")), r"-\d+$", "")


def to_samples(seconds: Column, fs: float) -> Column:
    """Seconds as whole samples, truncated."""
    return (seconds * fs).cast("bigint")


def to_seconds(samples: Column, fs: float) -> Column:
    return samples / fs


def label_number(c: Column) -> Column:
    """The number in a label such as p07, for ordering."""
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


def clip_floor(c: Column, least: float) -> Column:
    return F.greatest(c, F.lit(least))


def in_shard(c: Column, listed: str) -> Column:
    """Whether a value is in a list parted by commas; an empty list takes all."""
    names = [x.strip() for x in listed.split(",") if x.strip()]
    return c.isin(names) if names else F.lit(True)


def to_microvolts(samples: Column, least: float) -> Column:
    """Samples whose largest magnitude is under ``least`` are in volts and become microvolts; others stay."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.transform(samples, lambda x: F.when(peak < least, x * 1e6).otherwise(x))


def channels_first(matrix: Column) -> Column:
    """An array of rows with more rows than columns is turned, as there are more samples than channels."""
    columns = F.sequence(F.lit(0), F.size(matrix[0]) - 1)
    return F.when(F.size(matrix) > F.size(matrix[0]), F.transform(columns, lambda j: F.transform(matrix, lambda r: F.get(r, j)))).otherwise(matrix)
