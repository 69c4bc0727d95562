"""Vectorised word, shingle and MinHash arithmetic over Arrow string columns.

Everything here works on one bounded slice of an Arrow batch at a time, so a task's memory does not
depend on how many rows its partition has. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEGMENT = 1 << 18
CHUNK_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space of the word rule: space and \x09-\x0D.
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_VALUE = (_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        up = np.full(n + 1, _BASE, dtype=np.uint64)
        down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[n] = np.cumprod(up), np.cumprod(down)
    return _powers[n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products become evenly spread 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(column):
        before = int(ends[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield row, end
        row = end


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of about ``limit`` bytes; a longer text is a slice of its own."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's place in them."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _IN_WORD[data]
    edge = np.empty_like(inside)
    edge[0] = False
    edge[1:] = inside[:-1]
    first = offsets[:-1]
    edge[first[first < len(data)]] = False
    starts = np.flatnonzero(inside & ~edge)
    edge[-1] = False
    edge[:-1] = inside[1:]
    last = offsets[1:]
    edge[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased; equal words have equal hashes wherever they stand."""
    out, up_down, i = np.empty(len(starts), np.uint64), _power_tables(SEGMENT), 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + SEGMENT, "right"))
        if j <= i:  # a word beyond the segment
            out[i] = xxhash.xxh64_intdigest(_LOWER[data[starts[i] : ends[i]]].tobytes())
            i += 1
            continue
        part = data[starts[i] : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up_down[0][: len(part)], out=sums[1:])
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        out[i:j] = (sums[b] - sums[a]) * up_down[1][a]
        i = j
    return mix64(out ^ (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and each text's place in them.

    A text of fewer words, but not none, has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(at)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    places = np.zeros(len(at), np.int64)
    np.cumsum(counts, out=places[1:])
    out = np.empty(int(places[-1]), np.uint64)
    long = n >= k
    if long.any():
        runs = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            runs = runs * np.uint64(_BASE) + hashes[i : len(hashes) - k + 1 + i]
        whole = np.repeat(at[1:], n)[: len(runs)] >= np.arange(k, len(runs) + k)
        out[np.repeat(long, counts)] = runs[whole & np.repeat(long, n)[: len(runs)]]
    for t in np.flatnonzero((n > 0) & ~long):
        total = int(n[t]) * 0x2545F4914F6CDD1D
        for h in hashes[at[t] : at[t + 1]]:
            total = (total * _BASE + int(h)) & 0xFFFFFFFFFFFFFFFF
        out[places[t]] = total
    return mix64(out), places


def distinct(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, in an order of no meaning, and each text's place in them."""
    n = len(places) - 1
    bits = np.uint64(max(1, (n + 1).bit_length()))
    key = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(places)) << (np.uint64(64) - bits)) | (values >> bits)
    order = np.argsort(key, kind="stable")
    key = key[order]
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    first = np.arange(n, dtype=np.uint64) << (np.uint64(64) - bits)
    key = key[keep]
    return values[order][keep], np.append(np.searchsorted(key, first), len(key))


class MinHash:
    """``n`` universal hash permutations x -> a*x + b (mod 2^32, a odd) drawn from a seed."""

    def __init__(self, n: int, seed: int):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 1 << 32, n, dtype=np.uint32)

    def signatures(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """One row of minima for each text; 2^32 - 1 throughout where a text has no shingle."""
        out = np.full((len(places) - 1, len(self.a)), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(np.diff(places) > 0)
        if len(full):
            x = (values >> np.uint64(32)).astype(np.uint32)
            t, at = np.empty_like(x), places[:-1][full]
            for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                np.multiply(x, a, out=t)
                np.add(t, b, out=t)
                out[full, i] = np.minimum.reduceat(t, at)
        return out
