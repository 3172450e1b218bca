"""Vectorised text kernels over Arrow buffers: word bounds, word hashes, shingles.

Texts are handled as UTF-8 bytes. A batch is worked through in chunks of about ``CHUNK`` bytes, so
temporary arrays stay small whatever the batch holds; one longer text makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word; ``salt`` gives other functions."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _P & (2**64 - 1), np.uint64))])
    return _POWERS


def chunks(text: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for runs of rows; null counts as empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


SPACE = np.zeros(256, np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = 1


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes of one class above 0; rows part runs too."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = classes[data]
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    change[inner] = True
    at = np.flatnonzero(change)
    end = np.append(at[1:], len(data))
    keep = kind[at] > 0
    at, end = at[keep], end[keep]
    return at, end, np.searchsorted(offsets, at, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    powers = _powers(int(lengths.max()) + 1)
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    within = np.arange(int(lengths.sum()), dtype=np.int64)
    at = within + np.repeat(start - first, lengths)
    within -= np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        values = (data[at].astype(np.uint64) + np.uint64(1)) * powers[within]
        return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def sets_of_shingles(text: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its word shingles). Fewer words make one shingle, none none."""
    nonspace = 1 - SPACE
    for first, end, data, offsets in chunks(text):
        data = lowered(data)
        start, stop, row = words(data, offsets, nonspace)
        h = word_hashes(data, start, stop)
        bounds = np.searchsorted(row, np.arange(end - first + 1))
        with np.errstate(over="ignore"):
            mixed = np.zeros(max(0, len(h) - width + 1), np.uint64)
            for k in range(width):
                mixed = mix(mixed + h[k : k + len(mixed)], k + 1)
        for i in range(end - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                yield first + i, np.unique(mixed[a : b - width + 1])
            elif b > a:
                x = np.array([b - a], np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(a, b):
                        x = mix(x + h[k : k + 1], 101 + k - a)
                yield first + i, x
            else:
                yield first + i, np.zeros(0, np.uint64)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
