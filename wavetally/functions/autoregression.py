"""Vector autoregressions of many windows at once: fits, checks, and directed connectivity.

All arrays have the windows as their first axis: samples ``(windows, channels, times)``, coefficients
``(windows, channels, channels, lags)``, covariances ``(windows, channels, channels)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Numbers that one stacked intermediate result may hold, which bounds how many windows are worked on at a time.
STACK = 1 << 21
#: A channel of whose variance the others leave no more than this share has no rank of its own.
SINGULAR = 1e-12


def demeaned(x: np.ndarray) -> np.ndarray:
    """``x`` less each channel's mean."""
    return x - x.mean(axis=-1, keepdims=True)


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def _factor(m: np.ndarray, failed: np.ndarray) -> np.ndarray:
    """Cholesky factors; a window whose matrix has none is marked in ``failed`` and gets the identity."""
    m = np.where(failed[:, None, None] | ~np.isfinite(m).all(axis=(1, 2))[:, None, None], np.eye(m.shape[-1]), m)
    eye = np.eye(m.shape[-1])
    try:
        out = np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        out = np.broadcast_to(eye, m.shape).copy()
        for i, own in enumerate(m):
            try:
                out[i] = np.linalg.cholesky(own)
            except np.linalg.LinAlgError:
                failed[i] = True
    flat = (np.diagonal(out, axis1=1, axis2=2) ** 2 <= SINGULAR * np.diagonal(m, axis1=1, axis2=2)).any(axis=1)
    failed |= flat
    return np.where(flat[:, None, None], eye, out)


def fits(x: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Models of the orders 1 to ``most`` in one pass, ``(order, coefficients, residual covariance)``; NaN where a window has none.

    The multichannel lattice with normalised reflection coefficients: errors of predicting forward and backward
    in time are correlated one lag apart, and the correlation's coefficient turns both predictors of one order into those
    of the next. A window fails from the order on at which its errors have no full rank.
    """
    x = demeaned(np.asarray(x, float))
    count, n, t = x.shape
    failed = ~np.isfinite(x).all(axis=(1, 2))
    x = np.where(failed[:, None, None], 0.0, x)
    eye, none = np.eye(n), np.zeros((count, 1, n, n))
    ahead, behind = x[:, :, 1:], x[:, :, :-1]
    forward = np.linalg.inv(_factor(ahead @ _t(ahead), failed))[:, None]
    backward = np.linalg.inv(_factor(behind @ _t(behind), failed))[:, None]
    ahead, behind = forward[:, 0] @ ahead, backward[:, 0] @ behind
    for order in range(1, most + 1):
        if t - order < 2:
            return
        left, right = _factor(ahead @ _t(ahead), failed), _factor(behind @ _t(behind), failed)
        reflect = np.linalg.solve(left, _t(np.linalg.solve(right, behind @ _t(ahead))))
        to_ahead, to_behind = np.linalg.inv(_factor(eye - reflect @ _t(reflect), failed)), np.linalg.inv(_factor(eye - _t(reflect) @ reflect, failed))
        longer, later = np.concatenate((forward, none), axis=1), np.concatenate((none, backward), axis=1)
        forward = to_ahead[:, None] @ (longer - reflect[:, None] @ later)
        backward = to_behind[:, None] @ (later - _t(reflect)[:, None] @ longer)
        ahead, behind = to_ahead @ (ahead - reflect @ behind), to_behind @ (behind - _t(reflect) @ ahead)
        own = np.linalg.inv(forward[:, 0])
        residuals = own @ ahead
        gone = np.where(failed, np.nan, 0.0)[:, None, None]
        a = np.moveaxis(-own[:, None] @ forward[:, 1:], 1, -1) + gone[..., None]
        yield order, a, residuals @ _t(residuals) / (t - order - 1) + gone
        ahead, behind = ahead[:, :, 1:], behind[:, :, :-1]


def fit(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual covariances of one order; NaN where a window has no model, or is too short for any."""
    for k, a, s in fits(x, order):
        if k == order:
            return a, s
    count, n, _ = x.shape
    return np.full((count, n, n, order), np.nan), np.full((count, n, n), np.nan)


def information_criteria(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """AIC and BIC ``(windows, orders)`` of the orders 1 to ``most``, from one pass; NaN where a fit fails or has fewer times than parameters."""
    count, n, t = x.shape
    aic, bic = np.full((count, most), np.nan), np.full((count, most), np.nan)
    for p, _, s in fits(x, most):
        m = t - p
        if m <= n * p + 1:
            continue
        good = np.isfinite(s).all(axis=(1, 2))
        sign, logdet = np.linalg.slogdet(np.where(good[:, None, None], s, np.eye(n)))
        good &= sign > 0
        aic[good, p - 1], bic[good, p - 1] = (logdet + 2 * p * n * n / m)[good], (logdet + np.log(m) * p * n * n / m)[good]
    return aic, bic


def companion(a: np.ndarray) -> np.ndarray:
    """The first-order form of the models: a matrix of all lags."""
    count, n, _, p = a.shape
    top = np.moveaxis(a, -1, 2).reshape(count, n, n * p)
    return np.concatenate((top, np.broadcast_to(np.eye(n * (p - 1), n * p), (count, n * (p - 1), n * p))), axis=1)


def checks(a: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window why its model cannot be used ('' if it can), its spectral radius, and the lags after which it has decayed (0 if never)."""
    finite = np.isfinite(a).all(axis=(1, 2, 3)) & np.isfinite(sigma).all(axis=(1, 2))
    radius = np.abs(np.linalg.eigvals(companion(np.where(finite[:, None, None, None], a, 0.0)))).max(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        decay = np.where((radius > 0) & (radius < 1), np.ceil(np.log(np.finfo(float).eps) / np.log(radius)), 0)
    indefinite = ~finite
    _factor(sigma, indefinite)
    reason = np.where(~finite, "not finite", np.where(radius >= 1, "unstable", np.where(indefinite, "residuals not positive definite", "")))
    return reason, np.where(finite, radius, np.nan), np.where(finite, decay, 0).astype(np.int64)


def decay_resolution(decay: np.ndarray) -> np.ndarray:
    """The power of two that is not under the lags in which a model decays: bins from 0 to half the sampling rate."""
    return 1 << np.ceil(np.log2(np.maximum(decay, 1))).astype(np.int64)


def _riccati(a: np.ndarray, c: np.ndarray, q: np.ndarray, s: np.ndarray, r: np.ndarray, rounds: int = 60) -> np.ndarray:
    """State covariances of the innovations forms, by doubling."""
    ri = np.linalg.inv(r)
    at = _t(a - s @ ri @ c)
    g, h, eye = _t(c) @ ri @ c, q - s @ ri @ _t(s), np.eye(a.shape[-1])
    for _ in range(rounds):
        w = np.linalg.inv(eye + g @ h)
        step = _t(at) @ h @ w @ at
        g = g + at @ w @ g @ _t(at)
        at = at @ w @ at
        h = h + step
        if (np.abs(step).max(axis=(1, 2)) <= 1e-14 * np.maximum(np.abs(h).max(axis=(1, 2)), 1e-300)).all():
            break
    return (h + _t(h)) / 2


def _reduced(a: np.ndarray, sigma: np.ndarray, keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Gain and innovations covariance of the model of the channels ``keep`` alone."""
    big, n = companion(a), a.shape[1]
    own, part, k = sigma[:, keep][:, :, keep], sigma[:, :, keep], big.shape[1]
    c = big[:, keep]
    q, s = np.zeros_like(big), np.zeros((len(a), k, len(keep)))
    q[:, :n, :n], s[:, :n] = sigma, part
    p = _riccati(big, c, q, s, own)
    v = c @ p @ _t(c) + own
    return (big @ p @ _t(c) + s) @ np.linalg.inv(v), v


def _transfer(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The models' responses to innovations at the frequencies ``z``: ``(windows, frequencies, channels, channels)``."""
    powers = z[None, :] ** np.arange(1, a.shape[-1] + 1)[:, None]
    return np.linalg.inv(np.eye(a.shape[1]) - np.einsum("bijm,mf->bfij", a, powers))


def _ratios(out: np.ndarray, g: np.ndarray, v: np.ndarray, sigma: np.ndarray, source: int, keep: list[int]) -> None:
    """Fill in what ``source`` adds to each target of ``keep``: the log of the spectrum of its reduced innovations over the part that is not carried by others."""
    n = sigma.shape[-1]
    for row, i in enumerate(keep):
        rest = [k for k in range(n) if k != i]
        across = sigma[:, rest, i]
        partial = sigma[:, rest][:, :, rest] - across[:, :, None] * across[:, None, :] / sigma[:, i, i][:, None, None]
        own = g[:, :, row, rest]
        carried = np.einsum("bfk,bkl,bfl->bf", own, partial, own.conj(), optimize=True).real
        all_ = v[:, row, row][:, None]
        out[:, i, source] = np.log(all_) - np.log(np.maximum(all_ - carried, 1e-300))


def _circle(resolution: int) -> np.ndarray:
    return np.exp(-1j * np.pi * np.arange(resolution + 1) / resolution)


def spectral(a: np.ndarray, sigma: np.ndarray, resolution: int) -> np.ndarray:
    """Pairwise-conditional directed connectivity ``(windows, target, source, frequency)`` from 0 to half the sampling rate.

    For each source, the model without it has an innovations form, found from a Riccati
    equation. A target's spectrum of reduced innovations is constant; its part that the other
    full innovations carry, beyond what they share with the target's own, gives the ratio. The reduced model's response is
    found lag by lag, so that no matrix is larger than the number of channels.
    """
    count, n, _, p = a.shape
    z = _circle(resolution)
    out = np.zeros((count, n, n, resolution + 1))
    full = _transfer(a, z)
    at = z[None, :, None, None]
    for j in range(n):
        keep = [i for i in range(n) if i != j]
        gain, v = _reduced(a, sigma, keep)
        gains = gain.reshape(count, 1, p, n, len(keep))
        past, drive = np.zeros((count, 1, n, len(keep))), np.zeros((count, 1, n, len(keep)))
        for m in range(1, p):
            past = at * past + gains[:, :, m]
            drive = drive + a[:, None, :, :, m] @ past
        state = full @ (gains[:, :, 0] + at * drive)
        response = np.eye(len(keep)) + (state - gains[:, :, 0])[:, :, keep]
        _ratios(out, np.linalg.solve(response, full[:, :, keep]), v, sigma, j, keep)
    return out


def temporal(a: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Pairwise-conditional directed connectivity in the time domain, ``(windows, target, source)``."""
    n = a.shape[1]
    out = np.zeros((len(a), n, n))
    for j in range(n):
        keep = [i for i in range(n) if i != j]
        _, v = _reduced(a, sigma, keep)
        for row, i in enumerate(keep):
            out[:, i, j] = np.log(v[:, row, row] / sigma[:, i, i])
    return out


def autocovariances(a: np.ndarray, sigma: np.ndarray, lags: int) -> np.ndarray:
    """The models' autocovariances at the lags 0 to ``lags``, ``(windows, channels, channels, lags + 1)``: of a channel now with another one before.

    The covariance of all lags of a model solves a Lyapunov equation, by doubling; further lags follow from the model.
    """
    count, n, _, p = a.shape
    step = companion(a)
    state = np.zeros_like(step)
    state[:, :n, :n] = sigma
    for _ in range(64):
        more = step @ state @ _t(step)
        state, step = state + more, step @ step
        if (np.abs(more).max(axis=(1, 2)) <= 1e-17 * np.abs(state).max(axis=(1, 2))).all():
            break
    out = [state[:, :n, m * n : (m + 1) * n] for m in range(min(p, lags + 1))]
    while len(out) <= lags:
        out.append(sum(a[:, :, :, m] @ out[-m - 1] for m in range(p)))
    return np.stack(out, axis=-1)


def whittle(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The models whose autocovariances are ``g``, of as many lags, and their residual covariances: order by order, forward and backward in time."""
    lags = g.shape[-1] - 1
    g = np.moveaxis(g, -1, 0)
    forward, backward = np.zeros_like(g[:lags]), np.zeros_like(g[:lags])  # the backward one's last lag first
    ahead = behind = g[0]
    for k in range(lags):
        left = g[k + 1] - (forward[:k] @ g[k:0:-1]).sum(axis=0)
        to, fro = _t(np.linalg.solve(_t(behind), _t(left))), _t(np.linalg.solve(_t(ahead), left))
        longer = forward[:k] - to @ backward[:k]
        backward[1 : k + 1] = backward[:k] - fro @ forward[:k]
        forward[:k], forward[k], backward[0] = longer, to, fro
        ahead, behind = ahead - to @ _t(left), behind - fro @ left
    return np.moveaxis(forward, 0, -1), ahead


def spectral_by_autocovariance(a: np.ndarray, sigma: np.ndarray, resolution: int, lags: int) -> np.ndarray:
    """As :func:`spectral`, with the reduced models from the autocovariances of the channels that stay, up to ``lags``: the older route."""
    count, n, _, _ = a.shape
    z = _circle(resolution)
    out = np.zeros((count, n, n, resolution + 1))
    full, g = _transfer(a, z), autocovariances(a, sigma, lags)
    powers = z[None, :] ** np.arange(1, lags + 1)[:, None]
    for j in range(n):
        keep = [i for i in range(n) if i != j]
        model, v = whittle(g[:, keep][:, :, keep])
        whiten = np.eye(len(keep)) - np.einsum("bijm,mf->bfij", model, powers, optimize=True)
        _ratios(out, whiten @ full[:, :, keep], v, sigma, j, keep)
    return out


def band_means(f: np.ndarray, fs: float, bands) -> np.ndarray:
    """Trapezoid over the closed bands on the last axis, over each band's nominal width: ``(windows, band, target, source)``."""
    freq = np.linspace(0, fs / 2, f.shape[-1])
    out = []
    for _, lo, hi in bands:
        at = (freq >= lo) & (freq <= hi)
        out.append(np.trapezoid(f[..., at], freq[at], axis=-1) / (hi - lo))
    return np.stack(out, axis=1)


def off_diagonal(m: np.ndarray) -> np.ndarray:
    """``(windows, features)`` in the order of the feature map: band, then source, then target."""
    n = m.shape[-1]
    apart = ~np.eye(n, dtype=bool)
    return _t(m)[:, :, apart].reshape(len(m), -1)


def banded(a: np.ndarray, sigma: np.ndarray, resolution: int, fs: float, bands, lags: int | None = None) -> np.ndarray:
    """Feature vectors of the windows, so many at a time as a stack may hold; with ``lags``, by the older route."""
    n, out = a.shape[1], []
    step = max(1, STACK // ((resolution + 1) * n * n))
    for i in range(0, len(a), step):
        own = a[i : i + step], sigma[i : i + step], resolution
        out.append(off_diagonal(band_means(spectral(*own) if lags is None else spectral_by_autocovariance(*own, lags), fs, bands)))
    return np.concatenate(out) if out else np.zeros((0, len(bands) * n * (n - 1)))
