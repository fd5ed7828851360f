"""Vectorised words, word hashes and window hashes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 21

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_TABLES = {False: _BYTE, True: _FOLDED}


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made as far as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _full(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = self._full(self.base, size), self._full(self.inverse, size)
        return self.up[:n], self.down[:n]


_CHARS, _WORDS = _Powers(0x9E3779B97F4A7C15 | 1), {s: _Powers(b) for s, b in enumerate((0xD1342543DE82EF95, 0xA0761D6478BD642F))}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return body, offsets - low


def slices(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in slices of about ``most`` bytes of ``column``."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(body: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes of words, first word of each row as n + 1 positions).

    Words are runs without the white space of ASCII; ``fold`` makes A-Z count as a-z.
    """
    n = len(body)
    solid = ~WHITE[body] if n else np.zeros(0, bool)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    last = solid.copy()
    if n:
        first[1:] &= ~solid[:-1] | cut[1:n]
        last[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, span_hashes(body, starts, ends, fold), np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of the bytes of each span; spans come in order and do not overlap."""
    hashes = np.empty(len(starts), np.uint64)
    table, at = _TABLES[fold], 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        end = int(ends[to - 1])
        up, down = _CHARS.get(end - base + 1)
        total = np.zeros(end - base + 1, np.uint64)
        np.cumsum(table[body[base:end]] * up[: end - base], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = to
    return hashes


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words, over row limits as well."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, step = np.empty(len(hashes) - n + 1, np.uint64), 1 << 19
    for at in range(0, len(out), step):
        part = hashes[at : at + step + n - 1]
        up, down = _WORDS[seed].get(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        m = len(part) - n + 1
        out[at : at + m] = mix((total[n : n + m] - total[:m]) * down[:m] + np.uint64(n))
    return out


def spread(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + count]``, one behind the other."""
    ends = np.cumsum(counts)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with so many items: each item's row, and its place in the row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def with_distinct(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, value) pairs in order of both, and how often each stands there."""
    order = np.lexsort((values, keys))
    k, v = keys[order], values[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return k[at], v[at], np.diff(np.append(at, len(k)))
