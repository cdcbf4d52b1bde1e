"""Words, lines and windows of many texts at once, as numpy arrays.

Texts stay in the Arrow buffers they arrive in; nothing here makes a Python string.
A word is a run of bytes other than space and 0x09-0x0D.  Words, lines and windows
are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_HASH_BLOCK = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 5)


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit function of each value."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_PLACE = mix(np.arange(101, 117, dtype=_U)) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            table = np.full(n, base, _U)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=_U)
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry than texts).

    A null counts as empty.
    """
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Consecutive parts of a batch, of about ``limit`` bytes of text or one row."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end
    release()


def release() -> None:
    """Give memory that is no longer used back, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def spans(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes not ``apart``, and how many each text has."""
    inside = ~apart[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marks lie in each stretch between two offsets."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return np.diff(total[offsets])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and do not overlap."""
    out = np.empty(len(starts), _U)
    k = 0
    while k < len(starts):
        base = starts[k]
        end = max(int(np.searchsorted(ends, base + _HASH_BLOCK, side="right")), k + 1)
        power, inverse = _power_tables(max(_HASH_BLOCK, int(ends[end - 1] - base)) + 1)
        part = data[base : ends[end - 1]]
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
        first, last = starts[k:end] - base, ends[k:end] - base
        value = (total[last] - total[first]) * inverse[first]
        out[k:end] = mix(value + (last - first).astype(_U))
        k = end
    return out


def of_text(counts: np.ndarray) -> np.ndarray:
    """For each word (or line, or window) the number of its text."""
    return np.repeat(np.arange(len(counts)), counts)


def windows(
    words: np.ndarray, counts: np.ndarray, size: int = 5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, their first words' places, and how many
    each text has.  Only texts with at least ``size`` words have any."""
    n = np.maximum(counts - (size - 1), 0)
    if len(words) < size:
        return np.zeros(0, _U), np.zeros(0, np.int64), n
    ends = np.cumsum(counts)
    inside = np.zeros(len(words) + 1, np.int32)
    some = n > 0
    np.add.at(inside, (ends - counts)[some], 1)
    np.add.at(inside, (ends - counts + n)[some], -1)
    places = np.flatnonzero(np.cumsum(inside[:-1]))
    total = words[places] * _WORD_PLACE[0]
    for k in range(1, size):
        total += words[places + k] * _WORD_PLACE[k]
    return mix(total), places, n


def short_sequences(words: np.ndarray, counts: np.ndarray, size: int = 5) -> np.ndarray:
    """For each text with 1 to ``size`` - 1 words, a hash of its whole sequence; else 0."""
    out = np.zeros(len(counts), _U)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    for k in range(size - 1):
        has = short[counts[short] > k]
        out[has] += words[first[has] + k] * _WORD_PLACE[k]
    out[short] = mix(out[short] ^ mix(counts[short].astype(_U)))
    return out
