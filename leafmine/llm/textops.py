"""Words and their hashes for a whole Arrow batch of texts at once.

Texts stay the UTF-8 bytes of the batch: no Python string is made. A polynomial over the bytes,
summed up once, gives the hash of any word or span as a difference of two sums.
"""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; about 60 times as much memory is in use.
SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


SPACE = _space()


class Hasher:
    """Hashes of byte spans. lower: A-Z count as a-z. seed: another, independent hash."""

    def __init__(self, lower: bool = False, seed: int = 0):
        self.base = int(mix(np.array([seed * 7919 + 11], _U))[0]) & ~3 | 3
        self.inverse = pow(self.base, -1, 1 << 64)
        at = np.arange(256, dtype=_U)
        if lower:
            at[65:91] += _U(32)
        self.table = mix(at * _U(0x9E3779B97F4A7C15) + _U(seed + 1))
        self.up = self.down = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, base, _U)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.down[start]
        return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own house


def rows(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first row, last row + 1, bytes, offsets of the rows in them. Null is empty."""
    col = batch.column(batch.schema.get_field_index(text))
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word `[^\\x20\\x09-\\x0D]+`, and the index of each row's first word."""
    full = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = full[:-1], full[1:]
    start = np.flatnonzero(full & (~before | edge[:-1]))
    end = np.flatnonzero(full & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k values in a row (also of those that cross rows)."""
    n = max(0, len(values) - k + 1)
    out = np.zeros(n, _U)
    factor = 0x9E3779B97F4A7C15
    for j in range(k):
        out += values[j : j + n] * _U(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest of every w values in a row; of equal ones the rightmost."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, have = values, np.arange(len(values)), 1
    while have < w:
        step = min(have, w - have)
        m = len(low) - step
        right = low[step:] <= low[:m]
        low = np.where(right, low[step:], low[:m])
        at = np.where(right, at[step:], at[:m])
        have += step
    return at[:n]


def rolling(values: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Sums for Hasher.spans over spans of values (words) instead of bytes."""
    hasher._powers(len(values) + 1)
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * hasher.up[: len(values)], out=out[1:])
    return out


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, end), one range after another."""
    n = end - start
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(start - (np.cumsum(n) - n), n)
    return first + np.arange(total)


def joined(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray, sep: int = 0x20) -> tuple[bytes, np.ndarray]:
    """Kept pieces of each row with one separator byte between them: all bytes, and the rows' offsets,
    where each row that keeps a piece ends in one more separator."""
    n = (end - start + 1) * keep
    out = np.empty(int(n.sum()), np.uint8)
    to = np.cumsum(n)
    src = ranges(start[keep], end[keep] + 1)
    padded = np.append(data, np.uint8(sep))
    out[:] = padded[src]
    out[to[keep] - 1] = sep
    return out.tobytes(), np.concatenate(([0], to))[first]
