"""Word-shingle hashing over Arrow text columns, vectorised with numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text hashed at once: bounds the arrays of 8 bytes per character.
RUN_BYTES = 2_000_000
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, RUN_BYTES), base, _U)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` (UTF-8 bytes of texts that end at ``ends``), and each text's first word's index.

    The hash of a word is a difference of one running polynomial sum, so no word is ever cut out as a string.
    """
    data = _LOWER[data]
    word = ~_SPACE[data]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.empty(len(data), bool)
    first[:1], first[1:] = True, ~word[:-1]
    first[starts[starts < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1:], last[:-1] = True, ~word[1:]
    last[ends[ends > 0] - 1] = True
    s, e = np.flatnonzero(first & word), np.flatnonzero(last & word)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _power(_BASE, len(data)), out=total[1:])
    hashes = mix((total[e + 1] - total[s]) * _power(_INV, len(data))[s] + (e - s).astype(_U))
    return hashes, np.append(np.searchsorted(s, starts), len(s))


def text_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about RUN_BYTES: (index of the first, bytes, ends of the texts in them). Null is empty."""
    column = column.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset] if len(column) else 0
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(sizes):
        j, n = i + 1, sizes[i]
        while j < len(sizes) and n + sizes[j] <= RUN_BYTES:
            n += sizes[j]
            j += 1
        yield i, raw[at : at + n], np.cumsum(sizes[i:j])
        at, i = at + n, j


def shingle_runs(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run of texts: (index of the first, shingle hashes, bounds of each text's hashes in them).

    A text of fewer than ``k`` words, but at least one, has its whole word sequence as its only shingle.
    """
    for i, data, ends in text_runs(column):
        words, at = word_hashes(data, ends)
        count = np.diff(at)
        h = np.zeros(max(0, len(words) - k + 1), _U)
        for j in range(k):
            h = mix(h * _U(0xD6E8FEB86659FD93) + words[j : j + len(h)])
        n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
        to = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(to[-1], _U)
        whole = np.flatnonzero(count >= k)
        if len(whole):  # positions of all full windows: each text's range, put behind one another
            take = np.arange(n[whole].sum()) + np.repeat(at[whole] - np.concatenate([[0], np.cumsum(n[whole])[:-1]]), n[whole])
            put = np.arange(n[whole].sum()) + np.repeat(to[whole] - np.concatenate([[0], np.cumsum(n[whole])[:-1]]), n[whole])
            out[put] = h[take]
        for d in np.flatnonzero((count > 0) & (count < k)):
            x = np.full(1, 0x5851F42D4C957F2D + int(count[d]), _U)
            for w in words[at[d] : at[d + 1]]:
                x = mix(x * _U(0xD6E8FEB86659FD93) + w)
            out[to[d]] = x[0]
        yield i, out, to
