"""Operators over blocks of samples against whole channels and single windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.config import Config
from wavetally.functions import autoregression as ar, spectral as sp
from wavetally.operators import series as sr

SMALL = Config(fs=16, window_s=2.0, step_s=0.5)
BANDS = (("slow", 0.5, 2.0), ("fast", 4.0, 8.0))


def channels(lengths, n=3, seed=0):
    r = np.random.default_rng(seed)
    return {(f"r{k}", c): np.cumsum(r.standard_normal(t)) * 0.1 + r.standard_normal(t) for k, t in enumerate(lengths) for c in range(n)}


def blocks(spark, whole, size):
    rows = [(rec, c, b, x[b * size : (b + 1) * size].tolist()) for (rec, c), x in whole.items() for b in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "record string, channel int, block long, samples array<double>").repartition(5)


@pytest.mark.parametrize("size", [64, 300, 5000])
def test_filter_over_blocks_equals_the_whole_channel(spark, size):
    whole = channels([1, 2, 200, 641, 2000], 2)
    got = sr.filtered(blocks(spark, whole, size), ["record"], 64, 0.5, 20.0, pad=150)
    sections = sp.butterworth_highpass(4, 0.5, 64) + sp.notch(20.0, 20 / 30, 64)
    seen = {}
    for r in got.orderBy("block").collect():
        seen.setdefault((r.record, r.channel), []).extend(r.filtered)
        assert len(r.filtered) == len(r.samples)
    assert seen.keys() == whole.keys()
    for k, x in whole.items():
        assert np.abs(np.array(seen[k]) - sp.zero_phase(x, sections, 150)).max() < 1e-9


@pytest.mark.parametrize("size, segment", [(64, 64), (64, 17), (100, 32), (5000, 50)])
def test_spectra_over_blocks_equal_the_whole_channel(spark, size, segment):
    whole = channels([1, 2, 5, 64, 129, 640, 1001], 2)
    got = {}
    for r in sr.power_spectra(blocks(spark, whole, size), ["record"], 16, segment, size).orderBy("bin").collect():
        got.setdefault((r.record, r.channel), []).append(r.power)
    assert got.keys() == whole.keys()
    for k, x in whole.items():
        if len(x) > 1:
            assert np.array(got[k]) == pytest.approx(sp.welch(x, 16, segment)[1], rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError):
        sr.power_spectra(blocks(spark, whole, size), ["record"], 16, size + 1, size)


def windows_of(x):
    return [x[:, i : i + SMALL.window] for i in range(0, x.shape[1] - SMALL.window + 1, SMALL.step)]


@pytest.mark.parametrize("size", [40, 256])
def test_models_of_runs_equal_single_windows(spark, size, monkeypatch):
    monkeypatch.setattr(sr, "RUN", 5)
    whole = channels([31, 32, 500, 323])
    df = blocks(spark, whole, size)
    got = {(r.record, r.w): r for r in sr.window_models(df, ["record"], SMALL, size, 2, None, BANDS).collect()}
    orders = {(r.record, r.w): r.order for r in sr.model_orders(df, ["record"], SMALL, size, 4).collect()}
    health = {(r.record, r.w): r for r in sr.covariance_health(df, ["record"], SMALL, size).collect()}
    want = {}
    for rec in ("r0", "r1", "r2", "r3"):
        x = np.stack([whole[rec, c] for c in range(3)])
        want |= {(rec, w): v for w, v in enumerate(windows_of(x))}
    assert got.keys() == orders.keys() == health.keys() == want.keys() and sum(r.valid for r in got.values()) > 50
    for k, x in want.items():
        a, s = ar.fit(x[None], 2)
        reason, radius, decay = ar.checks(a, s)
        assert (got[k].valid, got[k].reason, got[k].decay) == (reason[0] == "", reason[0], decay[0]) and got[k].radius == pytest.approx(radius[0])
        if reason[0] == "":
            r = int(ar.decay_resolution(decay)[0])
            f = ar.spectral(a, s, r)[0]
            freq = np.linspace(0, 8, r + 1)
            bands = [[np.trapezoid(f[t, j][(freq >= lo) & (freq <= hi)], freq[(freq >= lo) & (freq <= hi)]) / (hi - lo) for j in range(3) for t in range(3) if t != j] for _, lo, hi in BANDS]
            assert got[k].resolution == r and got[k].features == pytest.approx(sum(bands, []), abs=1e-9)
        bic = ar.information_criteria(x[None], 4)[1][0]
        assert orders[k] == (None if np.isnan(bic).all() else int(np.nanargmin(bic)) + 1)
        assert health[k].most == pytest.approx(np.linalg.eigvalsh(np.cov(x))[-1]) and health[k].n_bad == 0 and health[k].rank == 3


def test_missing_samples_and_guard(spark, monkeypatch):
    whole = channels([200])
    whole["r0", 1][100:105] = np.nan
    df = blocks(spark, whole, 64).where("not (channel = 2 and block = 0)")
    got = {r.w: r for r in sr.window_models(df, ["record"], SMALL, 64, 1, 32, BANDS).collect()}
    holds = lambda w, lo, hi: w * 8 < hi and w * 8 + 32 > lo
    assert {w for w, r in got.items() if not r.valid} == {w for w in range(22) if holds(w, 0, 64) or holds(w, 100, 105)}
    assert {r.reason for r in got.values()} == {"", "not finite"} and all((r.features is None) == (not r.valid) for r in got.values())
    monkeypatch.setattr(sr, "FINEST", 4)
    assert {r.reason for r in sr.window_models(df, ["record"], SMALL, 64, 1, None, BANDS).collect()} == {"resolution too fine", "not finite"}


def test_routes_agree_and_resolutions_are_close(spark):
    df = blocks(spark, channels([400]), 100)
    make = lambda r, lags=None: sr.window_models(df, ["record"], SMALL, 100, 1, r, BANDS, lags)
    assert all(r.r > 1 - 1e-9 and r.mae < 1e-6 for r in sr.agreement(make(64), make(64, 200), ["record", "w"]).collect())
    fine = sr.agreement(make(512), make(64), ["record", "w"]).collect()
    assert len(fine) == 47 and all(r.r > 0.95 and 0 < r.mae < 0.1 for r in fine)


def test_numbers_and_blocks(spark):
    df = spark.createDataFrame([(k % 3, k * k, float(k)) for k in range(100)], "record int, at long, x double")
    got = sr.numbered(df, ["record"], "at")
    assert {(r.record, r.s, r.x) for r in got.collect()} == {(k % 3, k // 3, float(k)) for k in range(100)}
    b = sr.blocks_of(got.withColumn("channel", F.lit(0)), ["record"], 7).orderBy("record", "block").collect()
    assert [v for r in b if r.record == 1 for v in r.samples] == [float(k) for k in range(1, 100, 3)] and {len(r.samples) for r in b} == {7, 5, 6}
