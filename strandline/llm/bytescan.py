"""Numpy kernels over whole batches of UTF-8 text: words, fingerprints, ragged gathers.

Everything works on the bytes of an Arrow string column, so no text is decoded unless an operator needs characters. Both word definitions used
here treat every byte from 0x80 up as part of a word, which makes the byte view exact for UTF-8.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on; arrays of eight bytes a character stay small.
SLICE_BYTES = 1 << 20

#: Bases of two independent families of fingerprints.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF93)
#: A random value for each byte: no two texts that differ in a regular way (case, say) get related fingerprints.
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[family][0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASES[family], pow(_BASES[family], -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[family][k] = np.multiply.accumulate(table)
    return _powers[family][0][:n], _powers[family][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of a polynomial value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling_prefix(values: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums from which span_hash() gives the Rabin-Karp value of any span."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), family)[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit fingerprints of values[starts:ends]; equal spans have equal fingerprints, wherever they stand."""
    inverse = powers(len(prefix), family)[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_values(data: np.ndarray) -> np.ndarray:
    """A value for each run of eight bytes, by its first byte. Fingerprints over them don't share the regularities of those over single bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return mix(np.ndarray((len(data),), "<u8", padded, strides=(1,)).astype(np.uint64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[0], starts[0]+1, ... of each span in turn."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


@dataclass
class Texts:
    """Consecutive texts of a batch. data: their bytes; starts, ends: of each text in data; rows: their place in the batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: slice

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def __len__(self) -> int:
        return len(self.starts)


def texts(column: pa.Array, target: int = SLICE_BYTES):
    """Cut a string column into Texts of about target bytes. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + target, side="right")) - 1
        high = min(n, max(high, low + 1))
        at = offsets[low : high + 1] - offsets[low]
        yield Texts(data[offsets[low] : offsets[high]], at[:-1], at[1:], slice(low, high))
        low = high


#: Bytes outside words: `[^\x20\x09-\x0D]+` are words of WHITE, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased text are words of PLAIN.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
PLAIN[0x41:0x5B] = False  # A-Z are lower-cased first
#: The same for bytes.translate: lower-cases A-Z and makes every other byte outside words a blank.
PLAIN_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if PLAIN[c] else c for c in range(256))
LOWER = np.frombuffer(bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)), np.uint8)
LOWER_VALUES = BYTE_VALUES[LOWER]


@dataclass
class Words:
    """Words of Texts: byte spans, fingerprints, and the number of words before each text (with the total at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(part: Texts, outside: np.ndarray, values: np.ndarray = BYTE_VALUES) -> Words:
    data = part.data
    if not len(data):
        return Words(*(np.empty(0, np.int64) for _ in range(2)), np.empty(0, np.uint64), np.zeros(len(part) + 1, np.int64))
    inside = ~outside[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = part.starts[(part.starts > 0) & (part.starts < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = span_hash(rolling_prefix(values[data]), starts, ends)
    first = np.searchsorted(starts, np.append(part.starts, len(data)))
    return Words(starts, ends, hashes, first)


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window of size words of one text, and the number of windows of each text."""
    counts = np.maximum(found.counts() - size + 1, 0)
    return ragged(found.first[:-1], counts), counts


def window_hashes(found: Words, at: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Rabin-Karp fingerprints of the windows of size words that begin with the words at."""
    return span_hash(rolling_prefix(found.hashes, family), at, at + size, family)


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of n places lie in one of the windows [at, at + size)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + size, n), -1)
    return np.cumsum(edge[:-1]) > 0
