"""Words, hashes and n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

White space is the bytes 20 and 09 to 0D (hex), which never occur inside a longer UTF-8
character, so cutting bytes cuts the same words as cutting characters would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # texts worked on at once; one longer text is worked on alone

_RNG = np.random.default_rng(20_24)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUE_LOWER = VALUE[LOWER]
LOW = 12  # low bits of a place, whose powers are in a table
LOW_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << LOW) - 1, BASE)]), dtype=np.uint64)
LOW_BACK = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << LOW) - 1, BASE_BACK)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over runs of rows with at most `limit` bytes, or one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        offsets = ends[row : stop + 1] - ends[row]
        yield row, raw[ends[row] : ends[stop]], offsets
        row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and end of every word."""
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


class Rolling:
    """Hashes of any byte ranges of one chunk, from prefix sums modulo 2**64.

    Held are eight bytes for a byte of text; powers come from two tables, by the low and the high
    bits of a place.
    """

    def __init__(self, data: np.ndarray, lower: bool = True):
        n, table, step = len(data), VALUE_LOWER if lower else VALUE, 1 << LOW
        steps = np.ones((2, (n >> LOW) + 1), dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = LOW_POWER[-1:] * BASE, LOW_BACK[-1:] * BASE_BACK
        high, self.high_back = np.cumprod(steps, axis=1, dtype=np.uint64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        for k, at in enumerate(range(0, n, step)):
            piece = table[data[at : at + step]]
            sums = np.cumsum(piece * (LOW_POWER[: len(piece)] * high[k]), dtype=np.uint64)
            self.sums[at + 1 : at + 1 + len(piece)] = sums + self.sums[at]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = self.high_back[start >> LOW] * LOW_BACK[start & ((1 << LOW) - 1)]
        return mix((self.sums[end] - self.sums[start]) * back + (end - start).astype(np.uint64))


def word_grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of all runs of n words."""
    if len(hashes) < n:
        return doc[:0], hashes[:0]
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * BASE + hashes[k : len(hashes) - n + 1 + k]
    whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
    return doc[: len(doc) - n + 1][whole], mix(total[whole])


def distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, hash) pairs, sorted."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[first], hashes[first]


def starts_of(doc: np.ndarray, count: int) -> np.ndarray:
    """Where each text's entries begin in a sorted array of text numbers; count + 1 entries."""
    return np.searchsorted(doc, np.arange(count + 1))


def long_lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """An Arrow array of lists of 64-bit numbers."""
    return pa.ListArray.from_arrays(
        pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64), type=pa.int64())
    )
