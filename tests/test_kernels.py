"""Numerical kernels against closed forms and brute force."""

import numpy as np
import pytest

from wavetally.functions import autoregression as ar, spectral as sp
from wavetally.functions import kernel_svm
from wavetally.functions.kernel_svm import KernelSvm
from wavetally.operators.selection import f_and_correlation, greedy_ranking
from wavetally.operators.stats import correlation_p, incomplete_beta


def simulate(a, n, seed=0):
    r, k, p = np.random.default_rng(seed), a.shape[0], a.shape[2]
    x = np.zeros((k, n + 200))
    for t in range(p, n + 200):
        x[:, t] = sum(a[:, :, m] @ x[:, t - m - 1] for m in range(p)) + r.standard_normal(k)
    return x[:, 200:]


EDGES = np.array([[0.5, 0.0, 0.0], [0.4, 0.3, 0.0], [0.0, 0.0, 0.6]])[:, :, None]


def least_squares(x, order):
    """The plain regression of one window."""
    x = x - x.mean(axis=1, keepdims=True)
    n, t = x.shape
    past = np.concatenate([x[:, order - k - 1 : t - k - 1] for k in range(order)])
    a = np.linalg.lstsq(past.T, x[:, order:].T, rcond=None)[0].T
    e = x[:, order:] - a @ past
    return a.reshape(n, order, n).transpose(0, 2, 1), e @ e.T / (t - order - 1)


def plain_connectivity(a, sigma, z):
    """One window and frequency: the reduced models' spectra by a long model of the others, from autocovariances and a block-Toeplitz solve."""
    n, _, p = a.shape
    lags = 80
    g = [ar.autocovariances(a[None], sigma[None], lags)[0, :, :, k] for k in range(lags + 1)]
    h = np.linalg.inv(np.eye(n) - sum(a[:, :, m] * z ** (m + 1) for m in range(p)))
    out = np.zeros((n, n))
    for j in range(n):
        keep = [i for i in range(n) if i != j]
        own = [x[np.ix_(keep, keep)] for x in g]
        model, v = toeplitz(own)
        whiten = np.eye(n - 1) - sum(model[m] * z ** (m + 1) for m in range(lags))
        response = whiten @ h[keep]
        for row, i in enumerate(keep):
            rest = [k for k in range(n) if k != i]
            partial = sigma[np.ix_(rest, rest)] - np.outer(sigma[rest, i], sigma[rest, i]) / sigma[i, i]
            carried = (response[row, rest] @ partial @ response[row, rest].conj()).real
            out[i, j] = np.log(v[row, row] / (v[row, row] - carried))
    return out


def toeplitz(g):
    """The model of autocovariances ``g`` from its normal equations, solved at once."""
    k, n = len(g) - 1, len(g[0])
    at = lambda d: g[d] if d >= 0 else g[-d].T
    left = np.block([[at(c - r) for c in range(k)] for r in range(k)])
    a = np.linalg.solve(left.T, np.concatenate(g[1:], axis=1).T).T
    return [a[:, m * n : (m + 1) * n] for m in range(k)], g[0] - sum(a[:, m * n : (m + 1) * n] @ g[m + 1].T for m in range(k))


def test_var_recovers_its_coefficients():
    a, sigma = ar.fit(simulate(EDGES, 40_000)[None], 1)
    assert np.abs(a[0] - EDGES).max() < 0.03 and np.abs(sigma[0] - np.eye(3)).max() < 0.03


@pytest.mark.parametrize("order", [1, 3, 6])
def test_fit_comes_to_least_squares(order):
    """The lattice's estimate differs from the regression's by the order of one over the samples; the first order has no difference."""
    for n, bound in ((300, 0.1), (30_000, 1e-3)):
        x = simulate(EDGES, n, seed=order)
        a, s = ar.fit(x[None], order)
        want = least_squares(x, order)
        assert np.abs(a[0] - want[0]).max() < (1e-10 if order == 1 else bound) and np.abs(s[0] / want[1] - 1).max() < 40 * bound


def test_one_pass_gives_every_order():
    x = np.stack([simulate(EDGES, 500, seed=k) for k in range(4)])
    for k, a, s in ar.fits(x, 5):
        own = [ar.fit(y[None], k) for y in x]
        assert np.abs(a - np.concatenate([o[0] for o in own])).max() < 1e-12 and np.abs(s - np.concatenate([o[1] for o in own])).max() < 1e-12


def test_bad_windows_do_not_stop_others():
    x = np.stack([simulate(EDGES, 300, seed=k) for k in range(5)])
    x[1, 0, 7], x[3] = np.nan, 0.0
    x[2, 1] = x[2, 0]
    a, s = ar.fit(x, 2)
    assert [bool(np.isfinite(v).all()) for v in a] == [True, False, False, False, True]
    assert np.abs(a[[0, 4]] - ar.fit(x[[0, 4]], 2)[0]).max() < 1e-12
    assert ar.checks(a, s)[0].tolist() == ["", "not finite", "not finite", "not finite", ""]
    assert np.isnan(ar.fit(x[:, :, :3], 4)[0]).all()


def test_connectivity_is_zero_where_there_is_no_edge_and_integrates_to_the_time_domain():
    sigma = np.array([[1.0, 0.2, 0.0], [0.2, 1.0, 0.1], [0.0, 0.1, 1.0]])
    f, t = ar.spectral(EDGES[None], sigma[None], 512)[0], ar.temporal(EDGES[None], sigma[None])[0]
    mean = np.trapezoid(f, axis=-1) / 512
    assert np.abs(mean - t).max() < 1e-4
    edges = {(i, j) for i in range(3) for j in range(3) if i != j and t[i, j] > 1e-6}
    assert edges == {(1, 0)}


def stable_models(n, p, count, seed):
    r, a, s = np.random.default_rng(seed), [], []
    while len(a) < count:
        c = r.standard_normal((n, n, p)) * 0.4 / p
        if np.abs(np.linalg.eigvals(ar.companion(c[None])[0])).max() < 0.8:
            m = r.standard_normal((n, n))
            a.append(c)
            s.append(m @ m.T + np.eye(n))
    return np.array(a), np.array(s)


@pytest.mark.parametrize("n, p", [(2, 1), (3, 2), (4, 5)])
def test_two_routes_and_a_plain_solve_agree(n, p):
    a, s = stable_models(n, p, 4, n)
    f, older = ar.spectral(a, s, 16), ar.spectral_by_autocovariance(a, s, 16, 80)
    assert np.abs(f - older).max() < 1e-6
    for k, at in enumerate((0, 5, 9, 16)):
        assert np.abs(plain_connectivity(a[k], s[k], np.exp(-1j * np.pi * at / 16)) - f[k, :, :, at]).max() < 1e-6


def test_whittle_equals_a_block_toeplitz_solve():
    a, s = stable_models(3, 2, 2, 1)
    g = ar.autocovariances(a, s, 7)
    model, v = ar.whittle(g)
    for k in range(2):
        want, w = toeplitz([g[k, :, :, m] for m in range(8)])
        assert np.abs(model[k] - np.stack(want, axis=-1)).max() < 1e-10 and np.abs(v[k] - w).max() < 1e-10
        assert np.abs(model[k][:, :, :2] - a[k]).max() < 1e-9 and np.abs(v[k] - s[k]).max() < 1e-9


def test_autocovariances_solve_their_equations():
    a, s = stable_models(3, 2, 3, 2)
    g = ar.autocovariances(a, s, 4)
    lag = lambda m: g[..., m] if m >= 0 else np.swapaxes(g[..., -m], 1, 2)
    for k in range(5):
        assert np.abs(lag(k) - sum(a[..., m] @ lag(k - m - 1) for m in range(2)) - (s if k == 0 else 0)).max() < 1e-10


def test_unstable_models_are_told():
    one = np.ones((3, 1, 1, 1))
    reason, radius, decay = ar.checks(one * np.array([1.1, 0.5, 0.5])[:, None, None, None], np.array([1.0, -1.0, 1.0])[:, None, None])
    assert reason.tolist() == ["unstable", "residuals not positive definite", ""] and radius.tolist() == pytest.approx([1.1, 0.5, 0.5]) and decay.tolist() == [0, 52, 52]
    assert ar.decay_resolution(np.array([1, 2, 3, 52, 64, 65])).tolist() == [1, 2, 4, 64, 64, 128]


def test_order_is_found():
    a = np.zeros((2, 2, 2))
    a[:, :, 1] = [[0.6, 0.0], [0.3, 0.5]]
    x = np.stack([simulate(a, 3000, seed=k) for k in range(3)])
    aic, bic = ar.information_criteria(x, 5)
    assert (np.nanargmin(bic, axis=1) + 1).tolist() == [2, 2, 2]
    s = least_squares(x[0], 2)[1]
    assert bic[0, 1] == pytest.approx(np.linalg.slogdet(s)[1] + np.log(2998) * 8 / 2998, abs=1e-3)
    assert np.isnan(ar.information_criteria(x[:, :, :12], 5)[1][:, 3:]).all()


def test_filters():
    fs, t = 256, np.arange(4096) / 256
    slow, hum, fine = np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 60 * t), np.sin(2 * np.pi * 10 * t)
    y = sp.zero_phase(slow + hum + fine, sp.butterworth_highpass(4, 0.5, fs) + sp.notch(60, 2, fs))
    mid = slice(1000, 3000)
    assert np.abs(y[mid] - fine[mid]).max() < 0.05


def test_blocks_equal_a_recursion():
    s = sp.butterworth_highpass(4, 0.5, 64)[0]
    x, y = np.random.default_rng(1).standard_normal(301), np.zeros(301)
    for i in range(301):
        y[i] = s[0] * x[i] + sum(s[k] * x[i - k] - s[k + 2] * y[i - k] for k in (1, 2) if i >= k)
    assert np.abs(sp._section(x, s)[0] - y).max() < 1e-10


def test_power_adds_up():
    x = np.random.default_rng(2).standard_normal(8192)
    f, p = sp.welch(x, 128, 512)
    assert abs(p.sum() * (f[1] - f[0]) - 1) < 0.1


def test_svm_meets_its_conditions():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(-1, 1, (60, 2)), r.normal(1, 1, (60, 2))])
    y = np.repeat([0, 1], 60)
    m = KernelSvm(1.0, 0.5, tolerance=1e-6).fit(x, y)
    s = np.where(y > 0, 1, -1) * m.decide(x)
    for margin, a in zip(s, np.abs(m.beta)):
        assert margin > 1 - 1e-3 if a < 1e-6 else margin < 1 + 1e-3 if a > 1 - 1e-6 else abs(margin - 1) < 1e-3
    assert (s > 0).mean() > 0.85


@pytest.mark.parametrize("c", [0.1, 10.0, 1000.0])
def test_svm_meets_its_conditions_beyond_rests(c, monkeypatch):
    """Resting multipliers and starts from a lower penalty end where a fit from nothing ends: no pair violates the conditions."""
    monkeypatch.setattr(kernel_svm, "LOOK", 50)
    r = np.random.default_rng(6)
    x = r.standard_normal((300, 5))
    y, w = ((x[:, 0] + x[:, 1] ** 2 + 0.5 * r.standard_normal(300)) > 1).astype(int), np.where(r.random(300) < 0.3, 2.0, 0.7)
    k = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    alone = KernelSvm(c, 0.1).fit(x, y, w)
    *_, (_, warm) = kernel_svm.along_penalties(x, y, w, [0.01, 0.1, 1.0, c] if c > 1 else [0.01, c], 0.1)
    objective = []
    for m in (alone, warm):
        s = np.where(y > 0, 1.0, -1.0)
        v, most = s - k @ m.beta, c * w
        up, low = np.where(s > 0, m.beta < most, m.beta < 0), np.where(s > 0, m.beta > 0, m.beta > -most)
        assert v[up].max() - v[low].min() < 1.01e-3 and abs(m.beta.sum()) < 1e-6 * c and (np.abs(m.beta) <= most + 1e-9).all() and (m.beta * s >= 0).all()
        objective.append(m.beta @ k @ m.beta / 2 - np.abs(m.beta).sum())
    assert objective[0] == pytest.approx(objective[1], rel=1e-3)


def test_ranking():
    f = np.array([3.0, 5.0, 5.0, 0.0, np.nan, 1.0])
    c = np.eye(6)
    c[1, 2] = c[2, 1] = 1.0
    assert greedy_ranking(f, c, 4) == [1, 0, 5, 2]
    assert greedy_ranking(f, c, 2) == greedy_ranking(f, c, 4)[:2]
    assert greedy_ranking(np.zeros(3), np.eye(3), 2) == []
    assert len(greedy_ranking(f, c, 99)) == 4


def test_f_values():
    r = np.random.default_rng(0)
    x, y = r.standard_normal((80, 3)), np.repeat([0, 1], [50, 30])
    x[y == 1, 0] += 1
    n, s = np.bincount(y).astype(float), np.stack([x[y == c].sum(0) for c in (0, 1)])
    f, c = f_and_correlation(n, s, x.T @ x)
    for k in range(3):
        a, b = x[y == 0, k], x[y == 1, k]
        within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
        between = 50 * (a.mean() - x[:, k].mean()) ** 2 + 30 * (b.mean() - x[:, k].mean()) ** 2
        assert f[k] == pytest.approx(between / (within / 78))
    assert c == pytest.approx(np.corrcoef(x.T))


def test_p_values():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert correlation_p(0.5, 20) == pytest.approx(0.0247, abs=1e-4)
    assert correlation_p(1.0, 5) == 0.0 and correlation_p(0.5, 2) is None
