"""Window-level metrics: confusion counts, curves, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import guarded_ratio, ratio_or_zero
from .stats import with_below


def confusion(scores: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """Counts and metrics per key; a metric without a denominator is null, and so is F1 where both its parts are zero."""
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    c = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(pos).alias("n_pos"), F.count_if(hit & pos).alias("tp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    return with_ratios(c)


def with_ratios(c: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    c = c.withColumns({"accuracy": guarded_ratio(tp + tn, tp + tn + fp + fn), "specificity": guarded_ratio(tn, tn + fp), "sensitivity": guarded_ratio(tp, tp + fn), "precision": guarded_ratio(tp, tp + fp)})
    s, p = F.col("sensitivity"), F.col("precision")
    return c.withColumn("f1", guarded_ratio(2 * s * p, s + p))


def curves(scores: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """Per key: ``auc`` from rank sums (null with one class), ``ap``, precision summed over the steps of recall (null without positives), and the counts of :func:`confusion`.

    All come from one table of counts per distinct score, and a key's scores are spread over tasks by ranges.
    """
    counts = with_below(scores.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum("y").alias("p")), keys, "score", ["n", "p"])
    rank = F.col("below_n") + (F.col("n") + 1) / 2.0
    step = F.col("p") * (F.col("all_p") - F.col("below_p")) / (F.col("all_n") - F.col("below_n"))  # precision of the scores from this one up
    hit, neg = F.col("score") >= threshold, F.col("n") - F.col("p")
    part = lambda test, c: F.coalesce(F.sum(F.when(test, c)), F.lit(0))
    s = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("p").alias("n_pos"), part(hit, F.col("p")).alias("tp"), part(~hit, neg).alias("tn"), part(hit, neg).alias("fp"), part(~hit, F.col("p")).alias("fn"),
        F.sum(rank * F.col("p")).alias("_ranks"), F.sum(step).alias("_steps"),
    )
    p, q = F.col("n_pos"), F.col("n") - F.col("n_pos")
    s = s.withColumns({"auc": guarded_ratio(F.col("_ranks") - p * (p + 1) / 2.0, p * q), "ap": guarded_ratio(F.col("_steps"), p)})
    return with_ratios(s.drop("_ranks", "_steps"))


def roc_auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, auc)``; see :func:`curves`."""
    return curves(scores, keys).select(*keys, "auc")


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ap)``; see :func:`curves`."""
    return curves(scores, keys).select(*keys, "ap")


def pooled(c: DataFrame) -> DataFrame:
    """Metrics of all counts together."""
    s = c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumns({"sensitivity": guarded_ratio(tp, tp + fn), "precision": guarded_ratio(tp, tp + fp), "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn)})


def median_of_medians(c: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """The median over groups of each group's median; nulls are skipped."""
    inner = c.groupBy(group).agg(*(F.median(m).alias(m) for m in metrics))
    return inner.agg(*(F.median(m).alias(m) for m in metrics))
