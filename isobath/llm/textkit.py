"""Whole texts as numpy arrays: words, lines and 64-bit hashes without a loop over words.

Texts of an Arrow batch lie in one byte buffer. A span's hash is a difference of
two prefix sums of byte codes times powers of an odd number, taken back to
position 0 by the inverse power; all arithmetic is modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers, _inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1)))


def pieces(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each; a longer row stands alone."""
    lo, n, ends = 0, len(lengths), np.cumsum(lengths)
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


def strings(column) -> pa.Array:
    """One Arrow string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len + 1 offsets into them."""
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, 8 * array.offset) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system, as a Python worker stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, without copies; what a batch took is given back after it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        give_back()


#: Bytes of texts whose words are arrays at once; a worker holds some eighty bytes for each.
PIECE_BYTES = 600_000


def text_pieces(array: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of bounded pieces of a batch."""
    array = strings(array)
    data, offsets = buffer_of(array)
    for lo, hi in pieces(np.diff(offsets), limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    give_back()


class Spans:
    """Hashes of any spans of one byte buffer."""

    def __init__(self, data: np.ndarray):
        _grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_CODES[data] * _powers[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _inverses[starts]
        return mix(raw ^ (ends - starts).astype(U))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes; none crosses a text's edge."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text (n + 1)."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds (an empty text has one empty line), and the lines before each text."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    counts = np.diff(np.searchsorted(feeds, offsets)) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(counts)])


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of width words that lie in one text, and the word each begins at."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n, U)
    for k in range(width):
        total = total * U(0xD6E8FEB86659FD93) + hashes[k : k + n]
    limit = np.repeat(firsts[1:], np.diff(firsts))[:n]
    at = np.flatnonzero(np.arange(n) + width <= limit)
    return mix(total[at]), at


def earlier(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found again in its text, and did it come before there?"""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(keys), bool)
    if len(keys):
        same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    later = np.zeros(len(keys), bool)
    later[order] = same
    many = same.copy()
    many[:-1] |= same[1:]
    found = np.zeros(len(keys), bool)
    found[order] = many
    return found, later


def per_text(flags: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of flags between firsts[i] and firsts[i + 1]."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]
