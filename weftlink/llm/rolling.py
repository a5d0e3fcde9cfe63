"""Hashes of all windows of a sequence, and each window's anchor, with numpy."""

from __future__ import annotations

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(32)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a pair of hashes, element by element; order matters."""
    with np.errstate(over="ignore"):
        h = a * _A + b * _B + _C
        h ^= h >> _S
        h *= _B
        h ^= h >> _S
        return h


def spans(units: np.ndarray, width: int) -> np.ndarray:
    """Hashes of units[i:i+width] for every i; units are uint64 hashes."""
    if len(units) < width:
        return np.zeros(0, np.uint64)
    out, covered, power, size = None, 0, units, 1
    # Widths of powers of two, put together by the binary digits of the width.
    while True:
        if width & size:
            if out is None:
                out = power
            else:
                n = len(units) - covered - size + 1
                out = join(out[:n], power[covered : covered + n])
            covered += size
        size *= 2
        if size > width:
            return out[: len(units) - width + 1]
        power = join(power[: len(power) - size // 2], power[size // 2 :])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least of values[i:i+width], the leftmost of equals."""
    n = len(values) - width + 1
    at, best, size = np.arange(len(values)), values, 1
    while size * 2 <= width:
        right = best[size:] < best[:-size]
        at = np.where(right, at[size:], at[:-size])
        best = np.where(right, best[size:], best[:-size])
        size *= 2
    rest = width - size
    if rest:
        right = best[rest : rest + n] < best[:n]
        return np.where(right, at[rest : rest + n], at[:n])
    return at[:n]


def blocks(units: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor hash, content hash, first window, number of windows, place of the anchor).

    A window's anchor is its least hash of ``anchor`` units, so equal windows
    have equal anchors at equal places, wherever they stand.  A block is a
    longest run of windows with the same anchor place; its content hash stands
    for all its units.
    """
    windows = spans(units, window)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    grams = spans(units, anchor)
    at = least(grams, window - anchor + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(at)])
    content = join(join(windows[first], windows[first + n - 1]), n.astype(np.uint64))
    return grams[at[first]], content, first, n, at[first]


def factors(phrases: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Longest runs of windows, given as phrases [low, high) that hold one window or more; in order, shorter than a window dropped.

    A phrase goes into the running factor if its first window begins no later
    than right behind the factor's last one.
    """
    out: list[tuple[int, int]] = []
    for low, high in sorted(phrases):
        if out and low <= out[-1][1] - window + 1:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return [f for f in out if f[1] - f[0] >= window]


def covered(length: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Whether each of length places lies in one of the ranges [low, high)."""
    edge = np.zeros(length + 1, np.int64)
    if ranges:
        r = np.array(ranges, np.int64)
        np.add.at(edge, r[:, 0], 1)
        np.add.at(edge, r[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


#: Windows handled at once, so that a text of any length needs bounded memory.
SEGMENT = 1 << 17


def segments(length: int, window: int) -> list[tuple[int, int]]:
    """Ranges of units that overlap by window - 1, so that each window lies in exactly one."""
    return [(at, min(length, at + SEGMENT + window - 1)) for at in range(0, max(0, length - window + 1), SEGMENT)]
