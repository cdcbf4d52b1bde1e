"""Sorted 64-bit values in few bytes, and their hash ranges."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values: the first, then differences, low bytes of all first."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1])
    width = (int(steps.max()).bit_length() + 7) // 8
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return values[:1].astype("<u8").tobytes() + np.ascontiguousarray(planes.T).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, _U)
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(-1, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : len(planes)] = planes.T
    return np.frombuffer(data, "<u8", 1)[0] + np.cumsum(steps.view("<u8").ravel(), dtype=_U)


def range_cuts(values: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of ``bits``-bit numbers begins in ascending values."""
    edges = np.array([((b << bits) + buckets - 1) // buckets for b in range(1, buckets)], _U)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def planes(values: np.ndarray) -> bytes:
    """Values of 0 and more: the low bytes of all first, as many bytes as the largest needs."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        part = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(part)] = part.T
    return out.view("<u8").ravel().astype(np.int64)


def gather(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of ``counts[k]`` entries from ``first[k]`` on, for every k in turn."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(int(counts.sum()))
