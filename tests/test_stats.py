"""Statistics whose inputs may be computed more than once, in another order of rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.operators import stats as st
from wavetally.plans import stat_queries


def test_rank_correlations_lose_no_row_that_is_computed_twice(spark):
    """Values that differ by rounding whenever they are computed: each row still counts, once."""
    r = np.random.default_rng(4)
    x = r.standard_normal(300)
    rows = [("k", float(v), float(v + e)) for v, e in zip(x, r.standard_normal(300))]
    unsteady = F.udf(lambda v: v + random.random() * 1e-12, "double").asNondeterministic()
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(3).withColumn("a", unsteady("a"))
    (got,) = st.spearman(df, ["k"], "a", "b").collect()
    rank = lambda c: np.argsort(np.argsort([row[c] for row in rows]))
    assert got.n == 300 and got.rho == pytest.approx(np.corrcoef(rank(1), rank(2))[0, 1])


def test_records_with_equal_windows_have_equal_figures(spark, tmp_path):
    """Windows in another order, whose doubles add up to other last digits, are no reason to rank records apart."""
    r = np.random.default_rng(6)
    values = [float(v) for v in np.round(r.gamma(2.0, 30.0, 60), 2)] + [None]
    rows = [(61 * u + i, datetime(2024, 1, 1, u % 24) + timedelta(minutes=i), u, "error" if i < 7 else "view", values[j]) for u in range(30) for i, j in enumerate(r.permutation(61))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    own = stat_queries.profiles(spark, str(tmp_path)).collect()
    assert len(own) == 30 and {(p.a, p.b, p.middle, p.d) for p in own} == {(own[0].a, own[0].b, own[0].middle, 61.0)}
    s = np.array(values[:-1]) - 50
    assert (own[0].a, own[0].b, own[0].middle, own[0].hits) == pytest.approx((s.mean(), s.std(ddof=1), np.median(s), (s >= 0).mean()))
    assert {(p.c, p.positives, p.alarms) for p in own} == {(7 / 61, 7.0, float((s >= 20).sum()))}
