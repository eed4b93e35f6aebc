"""Words, their 64-bit hashes and shingles, for whole Arrow text columns at once.

A word's hash is a polynomial over a random value per byte, taken from one running sum per piece of text, so no
Python object is made per word. ASCII letters count as lower case. Byte-wise work is exact: the bytes that
separate words never occur inside a longer UTF-8 character.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20   # bytes of text handled at once; longer texts are handled alone
PIECE = 1 << 20   # bytes of one running sum

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
PLACE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = BYTE_VALUE[LOWER]

#: Bytes that belong to a word: all but space and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for factor in (BASE, pow(BASE, -1, 2**64)):
            table = np.full(PIECE, factor, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows of up to CHUNK bytes. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        yield lo, hi, data[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
        lo = hi


def spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every word; a row's end also ends its last word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(at, start, "right") - 1, start, end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, *prefixes: int) -> list[np.ndarray]:
    """Hashes of the words, then of each word's first bytes for every length in ``prefixes`` (0 for shorter words)."""
    power, inverse = _power_tables()
    out = [np.zeros(len(start), np.uint64) for _ in range(1 + len(prefixes))]
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + PIECE, "right"))
        if j == i:  # one word longer than a piece
            word = LOWER[data[start[i]: end[i]]].tobytes()
            for k, cut in enumerate((len(word), *prefixes)):
                out[k][i] = int.from_bytes(hashlib.blake2b(word[:cut], digest_size=8).digest(), "little")
            i += 1
            continue
        a, b = start[i], end[j - 1]
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data[a:b]] * power[: b - a], out=total[1:])
        s = start[i:j] - a
        for k, cut in enumerate((None, *prefixes)):
            e = end[i:j] - a
            if cut is None:
                out[k][i:j] = mix((total[e] - total[s]) * inverse[s])
            else:
                enough = e - s >= cut
                e = np.minimum(s + cut, e)
                out[k][i:j] = np.where(enough, mix((total[e] - total[s]) * inverse[s] + np.uint64(cut)), 0)
        i = j
    return out


def shingles(row: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the k-word shingles; a row of fewer words gives its whole sequence as one."""
    n = len(row)
    if not n:
        return row, word
    full = max(0, n - k + 1)
    total = np.zeros(full, np.uint64)
    for j in range(k):
        total += word[j: j + full] * PLACE[j]
    ok = row[:full] == row[k - 1: k - 1 + full]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    short = count < k
    first, count = first[short], count[short]
    rest = np.zeros(len(first), np.uint64)
    for j in range(k - 1):
        there = j < count
        rest[there] += word[first[there] + j] * PLACE[j]
    rest += count.astype(np.uint64) * PLACE[k]
    rows = np.r_[row[:full][ok], row[first]]
    values = np.r_[mix(total[ok]), mix(rest)]
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row; ``row`` is sorted."""
    if not len(row):
        return row, value
    cut = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)]
    parts = [np.unique(value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return np.repeat(row[cut[:-1]], [len(p) for p in parts]), np.concatenate(parts)


def lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """A list column of ``n`` rows from values sorted by row."""
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(value))
