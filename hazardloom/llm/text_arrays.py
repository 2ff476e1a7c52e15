"""Vectorised word and window arithmetic on Arrow string batches.

All functions work on whole texts held as one UTF-8 byte buffer plus offsets,
so the per-word cost is a few NumPy passes and no Python object is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: odd multipliers of the rolling hashes (arithmetic is modulo 2**64)
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def text_slices(column: pa.Array, limit_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit_bytes`` of text (one row at least)."""
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], dtype=_offset_type(column))[column.offset : column.offset + n + 1].astype(np.int64)
    start = 0
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each row (what a null row's buffer holds counts too: nothing, as a rule)."""
    n = len(column)
    return np.diff(np.frombuffer(column.buffers()[1], dtype=_offset_type(column))[column.offset : column.offset + n + 1].astype(np.int64)) if n else np.zeros(0, np.int64)


def _offset_type(column: pa.Array):
    return np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], dtype=_offset_type(column))[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]
    return flat, ends - ends[0]


def ascii_lower(flat: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    out = flat.copy()
    out[(flat >= 65) & (flat <= 90)] += 32
    return out


def spaces(flat: np.ndarray) -> np.ndarray:
    """True at bytes 0x20 and 0x09 to 0x0D."""
    return (flat == 32) | ((flat >= 9) & (flat <= 13))


def word_spans(is_word: np.ndarray, offsets: np.ndarray, more_starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row) of the runs of ``is_word``, cut at row ends (and before ``more_starts``)."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if more_starts is not None:
        edge[more_starts] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:n]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def _inverse_powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(np.uint64(pow(int(base), -1, 1 << 64)), n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (position-free)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # spans are short: add the bytes at depth 0, 1, 2 ... of all spans that reach so far
    length = ends - starts
    out = np.zeros(len(starts), np.uint64)
    live = np.arange(len(starts))
    depth, limit = 0, 48
    while len(live) and depth < limit:
        at = starts[live] + depth
        out[live] = (out[live] + flat[at].astype(np.uint64) + np.uint64(1)) * _BYTE_BASE
        out[live] ^= out[live] >> np.uint64(29)
        depth += 1
        live = live[length[live] > depth]
    for i in live:  # the few very long words
        h = int(out[i])
        h ^= hash_bytes(flat[starts[i] + limit : ends[i]].tobytes())
        out[i] = h & 0xFFFFFFFFFFFFFFFF
    return mix(out + length.astype(np.uint64))


def hash_bytes(data: bytes) -> int:
    """A stable 64-bit hash of a byte string."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` words: entry i covers words i .. i + width - 1."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weighted = words * _powers(_WORD_BASE, len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(weighted, out=total[1:])
    return mix((total[width:] - total[:-width]) * _inverse_powers(_WORD_BASE, n))


def window_rows(bounds: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """True at window starts that stay inside one row; ``bounds`` are words before each row."""
    n = max(n_words - width + 1, 0)
    row_end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + width <= row_end
