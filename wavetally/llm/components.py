"""Connected components of a graph given by its edges, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written

#: Salts that a node's edges are dealt over, so that a hub does not meet in one task.
SALTS = 8


def _with_min(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges(u, v)`` with ``m``, the minimum that ``least(u, m)`` has for u; salted on u."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each round links every
    neighbour of a node to the smallest of them, until nothing changes. The
    rounds needed grow with the logarithm of the longest path. Edges with a null end and
    loops take no part; repeated edges count once; no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    before = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_min(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = _with_min(large, least)
        e = written(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
