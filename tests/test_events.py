"""Alarm runs, intervals and their scoring against loops in Python."""

import random

import pytest
from pyspark.sql import functions as F

from wavetally.config import DEFAULT
from wavetally.operators import events as ev
from wavetally.operators.intervals import merge_intervals, overlap_join, split_intervals


def loop_runs(scores, threshold, k):
    out, start = [], None
    for i, s in enumerate([*scores, float("-inf")]):
        if s >= threshold:
            start = i if start is None else start
        elif start is not None:
            if i - start >= k:
                out.append((start, i - 1, i - start))
            start = None
    return out


@pytest.mark.parametrize(
    "scores",
    [
        [random.Random(1).uniform(-1, 1) for _ in range(300)],
        [-1.0] * 20,
        [1.0] * 20,
        [1.0, 1.0, -1.0, 1.0, 1.0, 1.0],
        [1.0],
        [0.0, 0.0, 0.0, -0.1],
    ],
)
@pytest.mark.parametrize("k", [1, 3])
def test_runs_equal_a_loop(spark, scores, k):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(scores)], "record string, w long, score double")
    got = sorted((r.first_w, r.last_w, r.n) for r in ev.alarm_runs(df, ["record"], 0.0, k).collect())
    assert got == loop_runs(scores, 0.0, k)


def test_rounding_is_half_to_even(spark):
    runs = spark.createDataFrame([("a", 1, 3, 3), ("b", 3, 5, 3)], "record string, first_w long, last_w long, n long")
    lengths = spark.createDataFrame([("a", 100, 257.5), ("b", 100, 257.5)], "record string, n_windows long, duration double")
    got = {r.record: (r.start, r.end) for r in ev.alarm_intervals(runs, lengths, ["record"]).collect()}
    assert got == {"a": (2.0, 18.0), "b": (8.0, 22.0)}


@pytest.mark.parametrize("gap, n", [(89, 1), (90, 2), (91, 2)])
def test_merge_gap(spark, gap, n):
    df = spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0 + gap, 30.0 + gap)], "record string, start double, end double")
    assert merge_intervals(df, ["record"], DEFAULT.merge_gap_s).count() == n


@pytest.mark.parametrize("length, pieces", [(300, 1), (301, 2), (752, 3)])
def test_split_length(spark, length, pieces):
    df = spark.createDataFrame([("a", 5.0, 5.0 + length)], "record string, start double, end double")
    got = sorted((r.start, r.end) for r in split_intervals(df, 300).collect())
    assert len(got) == pieces and got[-1][1] == 5.0 + length and all(b - a <= 300 for a, b in got)


@pytest.mark.parametrize("start, end, hit", [(50, 70, False), (50, 70.5, True), (200, 210, False), (199.5, 210, True), (120, 130, True)])
def test_tolerance_is_strict_at_its_ends(spark, start, end, hit):
    ref = spark.createDataFrame([("a", 100.0, 140.0)], "record string, start double, end double")
    alarm = spark.createDataFrame([("a", float(start), float(end))], "record string, start double, end double")
    c = ev.event_counts(ref, alarm, ["record"]).first()
    assert (c.tp, c.fn, c.fp) == ((1, 0, 0) if hit else (0, 1, 1))


def test_overlap_join_equals_a_loop(spark):
    r = random.Random(3)
    left = [("k", i, (s := r.uniform(0, 5000)), s + r.uniform(0, 1500)) for i in range(60)]
    right = [("k", (s := r.uniform(0, 5000)), s + r.uniform(0, 900)) for i in range(40)]
    a, b = spark.createDataFrame(left, "key string, i int, start double, end double"), spark.createDataFrame(right, "key string, start double, end double")
    want = sorted((i, x) for _, i, s, e in left for _, x, y in right if s < y + 60 and e > x - 30)
    assert sorted((p.i, p.r_start) for p in overlap_join(a, b, ["key"], 30, 60).collect()) == want
    free = {i for i in range(60)} - {i for i, _ in want}
    assert {p.i for p in overlap_join(a, b, ["key"], 30, 60, "left_anti").collect()} == free


def test_empty_tables(spark):
    none = spark.createDataFrame([], "record string, start double, end double")
    assert ev.event_counts(none, none, ["record"]).count() == 0
    assert ev.scored_events(none, ["record"]).count() == 0
    assert ev.alarm_runs(spark.createDataFrame([], "record string, w long, score double"), ["record"]).agg(F.count("*")).first()[0] == 0
