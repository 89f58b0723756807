"""Numerical kernels of one channel: filters and spectra."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def butterworth_highpass(order: int, cut: float, fs: float) -> list[np.ndarray]:
    """Second-order sections ``(b0, b1, b2, a1, a2)`` of a Butterworth high-pass, by the bilinear transform."""
    w = np.tan(np.pi * cut / fs)
    out = []
    for k in range(order // 2):
        q = 2 * np.cos(np.pi * (2 * k + 1) / (2 * order))
        d = 1 + q * w + w * w
        out.append(np.array([1, -2, 1, 2 * (w * w - 1), 1 - q * w + w * w]) / d)
    return out


def notch(freq: float, width: float, fs: float) -> list[np.ndarray]:
    """A second-order section that removes one frequency."""
    w0, t = 2 * np.pi * freq / fs, np.tan(np.pi * width / fs)
    g = 1 / (1 + t)
    c = np.cos(w0)
    return [np.array([g, -2 * g * c, g, -2 * g * c, 2 * g - 1])]


@lru_cache(maxsize=256)
def _blocked(section: tuple, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A section over a block as matrices: from samples to samples, from the state to samples, from samples to the state, and from state to state by the number of samples."""
    b0, b1, b2, a1, a2 = section
    a = np.array([[-a1, 1.0], [-a2, 0.0]])
    b = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(powers[-1] @ a)
    impulse = np.array([b0, *(powers[k][0] @ b for k in range(block - 1))])
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    direct = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    observe = np.array([powers[k][0] for k in range(block)])
    drive = np.array([powers[block - 1 - k] @ b for k in range(block)]).T
    return direct, observe, drive, powers


def _section(x: np.ndarray, s: np.ndarray, state: np.ndarray | None = None, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """One section along the last axis from its ``state`` (at rest if none), and its state at the end: a block of samples at a time, as a small linear system."""
    direct, observe, drive, powers = _blocked(tuple(map(float, s)), block)
    n = x.shape[-1]
    state, out = np.zeros((*x.shape[:-1], 2)) if state is None else state, []
    for i in range(0, n, block):
        u = x[..., i : i + block]
        k = u.shape[-1]
        out.append(u @ direct[:k, :k].T + state @ observe[:k].T)
        state = state @ powers[k].T + u @ drive[:, block - k :].T
    return np.concatenate(out, axis=-1) if out else x.astype(float), state


def cascade(x: np.ndarray, sections: list[np.ndarray], state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after the other, from the states ``state`` (two numbers a section), and their states at the end."""
    ends = []
    for k, s in enumerate(sections):
        x, end = _section(x, s, None if state is None else state[..., 2 * k : 2 * k + 2])
        ends.append(end)
    return x, np.concatenate(ends, axis=-1) if ends else np.zeros((*x.shape[:-1], 0))


def mirrored(x: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and behind a signal whose ends are mirrored about their last values."""
    pad = min(pad, x.shape[-1] - 1)
    return 2 * x[..., :1] - x[..., pad:0:-1], 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1] if pad > 0 else x[..., :0]


#: Samples by which a signal is continued at its ends.
PAD = 256


def zero_phase(x: np.ndarray, sections: list[np.ndarray], pad: int = PAD) -> np.ndarray:
    """Sections forwards and backwards, with the ends mirrored about their last value."""
    before, behind = mirrored(x, pad)
    y = np.concatenate([before, x, behind], axis=-1)
    for _ in range(2):
        y = cascade(y, sections)[0][..., ::-1]
    return y[..., before.shape[-1] : before.shape[-1] + x.shape[-1]]


def periodograms(x: np.ndarray, segment: int, hop: int) -> tuple[np.ndarray, int]:
    """Sum of the squared spectra of the Hann segments that lie in ``x``, their means removed, and how many they are."""
    if x.shape[-1] < segment:
        return np.zeros((*x.shape[:-1], segment // 2 + 1)), 0
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = np.lib.stride_tricks.sliding_window_view(x, segment, axis=-1)[..., ::hop, :]
    return (np.abs(np.fft.rfft((parts - parts.mean(axis=-1, keepdims=True)) * w)) ** 2).sum(axis=-2), parts.shape[-2]


def density(total: np.ndarray, count: int, fs: float, segment: int) -> np.ndarray:
    """The power spectral density of ``count`` segments' summed squared spectra, from 0 to half of ``fs``."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    p = total / count / (fs * (w**2).sum())
    p[..., 1 : p.shape[-1] - (segment % 2 == 0)] *= 2
    return p


def welch(x: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density: Hann segments overlapping by half, means removed, averaged."""
    segment = min(segment, x.shape[-1])
    return np.fft.rfftfreq(segment, 1 / fs), density(*periodograms(x, segment, max(segment // 2, 1)), fs, segment)
