"""Directed, weighted networks of selected features: weights, degrees, concentration, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import guarded_ratio

BANDS, CHANNELS = 5, 18


def feature_map(spark: SparkSession, bands: int = BANDS, channels: int = CHANNELS) -> DataFrame:
    """``(feature_index, band, src, tgt)`` of all ordered pairs, source outer and target inner, band by band."""
    axis = lambda n, name, first: spark.range(first, first + n).select(F.col("id").cast("int").alias(name))
    rows = axis(bands, "band", 0).crossJoin(axis(channels, "src", 1)).crossJoin(axis(channels, "tgt", 1)).where("src <> tgt")
    index = channels * (channels - 1) * F.col("band") + (channels - 1) * (F.col("src") - 1) + (F.col("tgt") - 1) - F.when(F.col("tgt") > F.col("src"), 1).otherwise(0)
    return rows.select(index.cast("int").alias("feature_index"), "band", "src", "tgt")


def rank_weights(sel: DataFrame, top: int = 20) -> DataFrame:
    """``sel`` cut at rank ``top``, with ``weight``: the reversed rank, normalised per record, over the patient's number of records."""
    kept = sel.where(F.col("rank") <= top).withColumn("raw", (F.lit(top + 1) - F.col("rank")).cast("double"))
    records = kept.groupBy("patient").agg(F.count_distinct("record").alias("n_records"))
    kept = kept.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("patient", "record")))
    return kept.join(records, "patient").withColumn("weight", F.col("weight") / F.col("n_records"))


def with_total(df: DataFrame, value: str, keys: list[str], name: str = "total") -> DataFrame:
    """``df`` with the sum of ``value`` over ``keys`` (over all rows without keys), by an aggregate and a join rather than a window on few keys."""
    total = df.groupBy(*keys).agg(F.sum(value).alias(name)) if keys else df.agg(F.sum(value).alias(name))
    return df.join(total, keys) if keys else df.crossJoin(F.broadcast(total))  # one row without keys


def degrees(weights: DataFrame, keys: list[str], channels: int = CHANNELS) -> DataFrame:
    """``(keys, channel, out, in_, net, total, asym)`` for every channel of every key; channels without an edge have zeros."""
    ends = weights.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("channel"), F.col("weight").alias("out"), F.lit(0.0).alias("in_")), F.struct(F.col("tgt").alias("channel"), F.lit(0.0).alias("out"), F.col("weight").alias("in_")))).alias("e")).select(*keys, "e.*")
    zeros = weights.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(channels))).alias("channel"), F.lit(0.0).alias("out"), F.lit(0.0).alias("in_"))
    d = ends.unionByName(zeros).groupBy(*keys, "channel").agg(F.sum("out").alias("out"), F.sum("in_").alias("in_"))
    net, total = F.col("out") - F.col("in_"), F.col("out") + F.col("in_")
    return d.withColumns({"net": net, "total": total, "asym": guarded_ratio(net, total)})


def cumulative_share(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges in descending weight with their place and the running share of all weight."""
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "src", "tgt")
    run = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return edges.withColumns({"place": F.row_number().over(order), "share": run / F.sum("weight").over(Window.partitionBy(*keys))})


def reciprocity(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Weight that a reversed edge matches, over all weight."""
    back = edges.select(*keys, F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("weight").alias("back"))
    rows = edges.join(back, [*keys, "src", "tgt"], "left")
    return rows.groupBy(*keys).agg(guarded_ratio(F.sum(F.least("weight", F.coalesce("back", F.lit(0.0)))), F.sum("weight")).alias("reciprocity"))


def entropy(share: Column, n: int) -> Column:
    """An aggregate: normalised Shannon entropy of shares; zeros add nothing."""
    return -F.sum(F.when(share > 0, share * F.log(share)).otherwise(0.0)) / F.log(F.lit(float(n)))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, gini)`` of a value's distribution."""
    order = Window.partitionBy(*keys).orderBy(value)
    rows = df.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy(*keys))})
    return rows.groupBy(*keys).agg(guarded_ratio(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col(value)), F.first("n") * F.sum(value)).alias("gini"))


def mean_cosine(profiles: DataFrame, entity: str, dim: str, value: str) -> DataFrame:
    """Mean cosine similarity over pairs of entities; their profiles come in long form and absent dimensions are zeros."""
    norm = profiles.groupBy(entity).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm")).where("norm > 0")
    unit = profiles.join(norm, entity).select(entity, dim, (F.col(value) / F.col("norm")).alias("u"))
    # over pairs, the dot products add up to (|sum of unit vectors|^2 - n) / 2
    n = norm.agg(F.count("*").alias("n"))
    square = unit.groupBy(dim).agg(F.sum("u").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    return square.crossJoin(n).select(guarded_ratio(F.col("square") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"), F.col("n").alias("n_entities"))
