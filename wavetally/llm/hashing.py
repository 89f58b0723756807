"""Hashes of words and shingles, for a batch of texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

#: Bytes that are hashed at a time; words of more than ``LONG`` bytes are hashed by XXH64 one by one.
PIECE, LONG = 1 << 19, 64
_SPACES = b" \t\n\r\x0b\x0c"
_SPACE = re.compile(rb"[ \t-\r]")
_BASE = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte (upper case as lower, spaces 0), whether it is a space, and powers of the base and of its inverse."""
    values = np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    spaces = np.zeros(256, bool)
    spaces[list(_SPACES)] = True
    values[spaces] = 0
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * PIECE, _BASE, np.uint64))))
    inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * PIECE, pow(_BASE, -1, 1 << 64), np.uint64))))
    return values, spaces, power, inverse


_VALUES, _IS_SPACE, _POWER, _INVERSE = _tables()


def mixed(x: np.ndarray) -> np.ndarray:
    """``x`` with its bits well mixed; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _long(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.lower(), 7)


def _piece(data: bytes) -> np.ndarray:
    """Hashes of the words of ``data``: polynomials in a byte's value, from running sums over all bytes."""
    if len(data) > 2 * PIECE:  # a very long word is in it
        return np.concatenate([np.array([_long(w)], np.uint64) if len(w) > LONG else _piece(w) for w in data.split()] or [np.empty(0, np.uint64)])
    raw = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _POWER[: len(raw)], out=sums[1:])
    lens = (ends - starts).astype(np.uint64)
    h = mixed((sums[ends] - sums[starts]) * _INVERSE[starts] + lens * np.uint64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(lens > LONG).tolist():
        h[i] = _long(data[starts[i] : ends[i]])
    return h


def _pieces(data: bytes) -> Iterable[bytes]:
    at = 0
    while at < len(data):
        if len(data) - at <= PIECE:
            end = len(data)
        else:
            hit = _SPACE.search(data, at + PIECE)
            end = hit.start() if hit else len(data)
        yield data[at:end]
        at = end


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, one text behind the other, and each text's number of words.

    Words are parted by space and the characters 9 to 13; A-Z count as lower case. None has no words. A text of
    any length is hashed by pieces.
    """
    out, counts, short, n_short = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        nonlocal short, n_short
        if short:
            data = b"\n".join(t for _, t in short)
            h = _piece(data)
            raw = np.frombuffer(data, np.uint8)
            space = _IS_SPACE[raw]
            begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
            ends = np.cumsum([len(t) + 1 for _, t in short])
            upto = np.searchsorted(begins, ends)
            counts[[i for i, _ in short]] = np.diff(upto, prepend=0)
            out.append(h)
        short, n_short = [], 0

    for i, t in enumerate(texts):
        if not isinstance(t, str) or not t:
            continue
        data = t.encode("utf-8", "surrogatepass")
        if n_short + len(data) + 1 > PIECE:
            flush()
        if len(data) < PIECE:
            short.append((i, data))
            n_short += len(data) + 1
        else:
            own = [_piece(p) for p in _pieces(data)]
            counts[i] = sum(map(len, own))
            out += own
    flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """A well-mixed hash of each run of ``n`` words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    x = np.zeros(m, np.uint64)
    for k in range(n):
        x = (x ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return mixed(x)
