"""Vectorised text primitives shared by the operators: words, word hashes and shingles.

All functions work on the UTF-8 buffer of an Arrow string column, so a batch of documents costs a
handful of numpy passes instead of a Python loop over words.  Memory is bounded: callers cut a batch
into chunks of about `CHUNK` bytes, and hashing walks a chunk in pieces of about `PIECE` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
PIECE = 1 << 19

# Fixed value: the white space the contracts split words at, x09-x0D and x20.
SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOLS = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)]
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        table = [np.full(size, b, np.uint64) for b in (_BASE, inverse)]
        for x in table:
            x[0] = 1
            np.cumprod(x, out=x)
        if size > 8 * PIECE:  # one enormous word: not worth keeping
            return table[0], table[1]
        _powers[:] = table
    return _powers[0], _powers[1]


def column_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the buffer and, for each row, the index of its first word.

    A word never crosses a row boundary, whatever bytes stand on either side of it.
    """
    inside = ~space[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over random byte values, then mixed.

    Spans are in order and don't overlap.  The two families are independent of each other.
    """
    symbols = _SYMBOLS[family]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(int(np.searchsorted(ends, at + PIECE, "right")), i + 1)
        piece = buf[at : ends[j - 1]]
        power, inverse = _power_tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(symbols[piece] * power[: len(piece)], out=total[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        i = j
    return mix64(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; entry i is for words i to i+n-1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + size])
    return out


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles, A-Z as a-z; a shorter row's whole sequence is one."""
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offsets)
    words = word_hashes(buf, starts, ends)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
