"""Word shingles of whole Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 19), base, np.uint64)
        x[0] = 1
        _powers[name] = have = np.multiply.accumulate(x)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all rows, and the row of each word."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = ~space
    starts = word.copy()
    starts[1:] &= space[:-1]
    ends = word.copy()
    ends[:-1] &= space[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]  # rows touch without white space between them
    starts[cut] = word[cut]
    ends[cut - 1] = word[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    b = raw.astype(np.uint64) + np.uint64(1)
    if lower:
        b[(raw >= 65) & (raw <= 90)] += np.uint64(32)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(b * _powers_to(n, _P, "p"), out=sums[1:])
    h = (sums[e] - sums[s]) * _powers_to(n, _INV, "i")[s]
    return mix64(h ^ mix64((e - s).astype(np.uint64))), np.searchsorted(at, s, "right") - 1


def bounds(column: pa.Array, limit: int) -> list[int]:
    """Row numbers that cut a text column into slices of at most ``limit`` bytes, or of one row."""
    size = np.cumsum(np.diff(text_bytes(column)[1]))
    out = [0]
    while out[-1] < len(column):
        before = size[out[-1] - 1] if out[-1] else 0
        out.append(max(out[-1] + 1, int(np.searchsorted(size, before + limit, "right"))))
    return out


def sliced(batches, column: str, limit: int = 1 << 20):
    """The rows of the batches in slices of at most ``limit`` bytes of text, or of one row."""
    for b in batches:
        cut = bounds(b.column(column), limit)
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            yield b.slice(s, e - s)


def shingles(column: pa.Array, k: int, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, sorted by row and hash.

    A row with fewer words has its whole sequence as one shingle; one without words has none. Words are
    hashed in slices of ``limit`` bytes, as that takes many times the memory of the text.
    """
    cut = bounds(column, limit)
    parts = [_shingles(column.slice(s, e - s), k) for s, e in zip(cut[:-1], cut[1:], strict=True)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([r + s for (r, _), s in zip(parts, cut, strict=False)]), np.concatenate([h for _, h in parts])


def _shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_bytes(column)
    w, row = word_hashes(raw, at)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=len(column))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    acc = np.full(len(w), k, np.uint64)
    place = np.arange(len(w)) - first[row]
    left = count[row] - place  # words from here to the row's end
    padded = np.concatenate((w, np.zeros(k, np.uint64)))
    for i in range(k):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + np.where(left > i, padded[i : i + len(w)], np.uint64(i)))
    keep = (left >= k) | (place == 0)
    r, h = row[keep], acc[keep]
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]
