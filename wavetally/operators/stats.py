"""Statistics per feature and between columns, from sufficient statistics in SQL."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import guarded_ratio
from ..tables import stored


#: Buckets of a key's values in :func:`with_below`.
BUCKETS = 64


def with_below(counts: DataFrame, keys: list[str], value: str, columns: list[str], keep: Callable[[DataFrame], DataFrame] = lambda bounds: bounds) -> DataFrame:
    """``counts``, a row per key and distinct ``value``, with ``below_<c>`` and ``all_<c>``: the sums of each of ``columns`` over the key's smaller values, and over all of them.

    A key's values fall into buckets between approximate quantiles; rows are summed inside buckets and the
    buckets' own sums added, so that a key of any size is spread over tasks. Where the bounds lie does not change the sums,
    as long as all that reads them finds the same ones: ``keep`` may store them.
    """
    bounds = keep(counts.groupBy(*keys).agg(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 1000).alias("_bounds")))
    rows = counts.join(bounds, keys) if keys else counts.crossJoin(bounds)
    rows = rows.withColumn("_b", F.size(F.filter("_bounds", lambda x: x < F.col(value)))).drop("_bounds")
    sums = rows.groupBy(*keys, "_b").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a key
    every = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_b", *(F.coalesce(F.sum(f"_s_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in columns), *(F.sum(f"_s_{c}").over(every).alias(f"all_{c}") for c in columns))
    before = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [*keys, "_b"])
    return rows.withColumns({f"below_{c}": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns}).drop("_b", *(f"_o_{c}" for c in columns))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``(keys, name, ..)``: exact quantiles of each key's values, missing ones left out, between neighbours by straight lines; ``shares`` has each one's name.

    Rows are counted by value, and counts added up over ranges of values, so that a key of any size is spread over tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = with_below(counts, keys, value, ["n"])
    place = lambda q: (F.col("all_n") - 1) * q
    at = lambda r: F.max(F.when((F.col("below_n") <= r) & (r < F.col("below_n") + F.col("n")), F.col(value)))
    g = ranked.groupBy(*keys).agg(F.max("all_n").alias("all_n"), *(at(r(place(q))).alias(f"{side}_{name}") for name, q in shares.items() for side, r in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda name, q: F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * (place(q) - F.floor(place(q)))
    return g.select(*keys, *(between(name, q).alias(name) for name, q in shares.items()))


def standardise(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``long`` with ``z``: population z-scores per key; a constant key keeps scale one."""
    s = long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return long.join(s, keys).withColumn("z", (F.col(value) - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))


def anova_f(long: DataFrame, keys: list[str], value: str = "x", label: str = "y") -> DataFrame:
    """``(keys, f)`` of a one-way analysis of variance over the classes of ``label``; undefined ones become zero."""
    g = long.groupBy(*keys, label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    f = guarded_ratio(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return t.select(*keys, F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), F.coalesce(F.greatest(f, F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("f"))


def class_effects(long: DataFrame, keys: list[str], value: str = "x", label: str = "y") -> DataFrame:
    """Per key: class sizes and means, rank AUC, its distance from chance folded up, and Cohen's d with the pooled spread (0 without any)."""
    counts = with_below(long.groupBy(*keys, value).agg(F.count("*").alias("n"), F.sum(label).alias("p")), keys, value, ["n"])
    r = counts.withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2.0).groupBy(*keys).agg(F.sum(F.col("rank") * F.col("p")).alias("s"))
    pos = F.col(label) == 1
    g = long.groupBy(*keys).agg(
        F.count_if(pos).alias("n1"), F.count_if(~pos).alias("n0"), F.avg(F.when(pos, F.col(value))).alias("m1"), F.avg(F.when(~pos, F.col(value))).alias("m0"),
        F.var_samp(F.when(pos, F.col(value))).alias("v1"), F.var_samp(F.when(~pos, F.col(value))).alias("v0"),
    )
    sd = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    auc = guarded_ratio(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0"))
    out = g.join(r, keys).withColumn("auc", auc)
    return out.select(*keys, "n1", "n0", "m1", "m0", "auc", F.greatest("auc", 1 - F.col("auc")).alias("abs_auc"), F.when(sd > 0, (F.col("m1") - F.col("m0")) / sd).otherwise(0.0).alias("cohen_d"))


def ordered_moments(values: Column) -> Column:
    """``(mean, sd)`` of an array of structs ``(x, n)``, values that differ and how often each comes; sd is the sample's.

    Values are met in their order, so that equal sets have equal moments to the last digit, however their rows were dealt to tasks.
    """

    def met(s: Column, v: Column) -> Column:
        n, d = s["n"] + v["n"], v["x"] - s["mean"]
        return F.struct(n.alias("n"), (s["mean"] + d * v["n"] / n).alias("mean"), (s["m2"] + d * d * s["n"] * v["n"] / n).alias("m2"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    told = lambda s: F.struct(F.when(s["n"] > 0, s["mean"]).alias("mean"), F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1))).alias("sd"))
    return F.aggregate(F.array_sort(values), none, met, told)


def spearman(df: DataFrame, keys: list[str], a: str, b: str, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """``(keys, n, rho)``: correlation of average ranks; rows with a missing side do not count.

    Ranks are joined on the values, so that ``keep`` stores the rows: sums of doubles that are computed
    again, from rows that arrive in another order, need not be equal.
    """
    rows = keep(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b))

    def ranks(c: str, name: str) -> DataFrame:
        counts = with_below(rows.groupBy(*keys, c).agg(F.count("*").alias("n")), keys, c, ["n"], keep)
        return counts.select(*keys, c, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias(name))

    pairs = rows.groupBy(*keys, a, b).agg(F.count("*").alias("m")).join(ranks(a, "ra"), [*keys, a]).join(ranks(b, "rb"), [*keys, b])
    total = lambda x: F.sum(F.col("m") * x)
    t = pairs.groupBy(*keys).agg(F.sum("m").alias("n"), total(F.col("ra")).alias("x"), total(F.col("rb")).alias("z"), total(F.col("ra") * F.col("ra")).alias("xx"), total(F.col("rb") * F.col("rb")).alias("zz"), total(F.col("ra") * F.col("rb")).alias("xz"))
    cov = lambda u, v, uv: F.col(uv) - F.col(u) * F.col(v) / F.col("n")
    return t.select(*keys, "n", guarded_ratio(cov("x", "z", "xz"), F.sqrt(cov("x", "x", "xx")) * F.sqrt(cov("z", "z", "zz"))).alias("rho"))


def damped_weights(df: DataFrame, keys: list[str], label: str = "y", power: float = 0.5) -> DataFrame:
    """``(keys, label, n, weight)``: ``(n / (classes * n_class)) ** power``, scaled so that the mean over rows is one."""
    c = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    t = c.groupBy(*keys).agg(F.sum("n").alias("all"), F.count("*").alias("classes")) if keys else c.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    rows = (c.join(t, keys) if keys else c.crossJoin(F.broadcast(t))).withColumn("raw", F.pow(F.col("all") / (F.col("classes") * F.col("n")), F.lit(power)))
    s = rows.groupBy(*keys).agg((F.sum(F.col("raw") * F.col("n")) / F.first("all")).alias("mean")) if keys else rows.agg((F.sum(F.col("raw") * F.col("n")) / F.first("all")).alias("mean"))
    return (rows.join(s, keys) if keys else rows.crossJoin(F.broadcast(s))).select(*keys, label, "n", (F.col("raw") / F.col("mean")).alias("weight"))


def channel_correlations(df: DataFrame, vector: str) -> DataFrame:
    """``(a, b, r)`` for each pair a < b of a vector's places; tasks sum cross products, so what is gathered is places by places."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    m = Correlation.corr(rows, "v").first()[0].toArray()
    pairs = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(i + 1, len(m))]
    return df.sparkSession.createDataFrame(pairs, "a int, b int, r double")


def valid_columns(long: DataFrame, keys: list[str], column: str, versions: list[str]) -> DataFrame:
    """``(keys, column)`` of the columns without a missing value in any of the versions."""
    bad = F.lit(False)
    for v in versions:
        bad = bad | F.col(v).isNull() | F.isnan(v)
    return long.groupBy(*keys, column).agg(F.bool_or(bad).alias("_bad")).where("not _bad").drop("_bad")


def _continued(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def with_p(rows: DataFrame, r: str, n: str, name: str = "p") -> DataFrame:
    """``rows``, a bounded table of correlations, with the two-sided p-value of each by Student's t."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else correlation_p(float(a), int(b)) for a, b in zip(rs, ns)], dtype="float64")

    return rows.withColumn(name, p(r, n))


def chi_square_tail(x: "F.Column", df: int) -> "F.Column":
    """The upper tail of the chi-squared distribution for an even number of degrees of freedom, as a finite sum."""
    half, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * half / i
        total = total + term
    return F.exp(-half) * total


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation by Student's t; None for under three rows."""
    if n < 3 or r is None:
        return None
    return 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)
