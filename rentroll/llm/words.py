"""Words of whole texts as 64-bit hashes, computed on Arrow buffers in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # texts are handled together up to this many bytes; a longer text is a slice of its own
_U = np.uint64
_BASE, _BASE_INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table: true for bytes inside one of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


WHITE = separators((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of rows; a NULL text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    rows = len(texts)
    if not rows:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    if texts.null_count:
        keep = texts.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(at)[~keep] != 0).any():  # bytes under a NULL are undefined
            yield from slices(texts.fill_null(""), limit)
            return
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, flat[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(size, base, _U)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=_U)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, index of the first word of each row and after the last).

    Words are maximal runs of bytes outside ``apart``; they never span two rows.
    """
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, _U), np.zeros(rows + 1, np.int64)
    inside = ~apart[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((LOWER[data].astype(_U) + _U(1)) * up[:n], out=total[1:])
    words = mixed((total[last] - total[first]) * down[first] + (last - first).astype(_U) * _U(0xD6E8FEB86659FD93))
    return words, np.searchsorted(first, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: runs of ``size`` words, or all words of a row that has fewer."""
    return [s for s, _ in weighted_shingles(words, bounds, None, size)]


def weighted_shingles(words: np.ndarray, bounds: np.ndarray, weights: np.ndarray | None,
                      size: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``shingles``, with the sum of the weights of each shingle's words (all 0 without weights)."""
    factors = mixed(np.arange(1, size + 1, dtype=_U)) | _U(1)
    joined = np.zeros(max(0, len(words) - size + 1), _U)
    summed = np.zeros(len(joined), np.int64)
    for j in range(size):
        joined += words[j : j + len(joined)] * factors[j]
        if weights is not None:
            summed += weights[j : j + len(joined)]
    joined = mixed(joined + _U(size))
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = high - low
        if n >= size:
            row, weight = joined[low : high - size + 1], summed[low : high - size + 1]
            if weights is None:
                row = np.sort(row)
            else:
                order = np.argsort(row)
                row, weight = row[order], weight[order]
            if len(row) > 1:
                new = np.concatenate(([True], row[1:] != row[:-1]))
                row, weight = row[new], weight[new] if weights is not None else weight
        elif n:
            row = mixed((words[low:high] * factors[:n]).sum(dtype=_U, keepdims=True) + _U(n))
            weight = np.zeros(1, np.int64)
        else:
            row, weight = np.zeros(0, _U), np.zeros(0, np.int64)
        out.append((row, weight))
    return out
