"""Vectorised text primitives shared by the training-data operators.

Every helper works on one Arrow batch of texts at a time, inside a Spark task: a batch becomes a flat byte buffer with
row offsets, which is cut into chunks of about a megabyte (one row is never cut), so memory is bounded by the chunk size
or the longest single text. All hashes are 64-bit and deterministic; nothing depends on Python's hash seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20
#: Rows of a step at most, so that a row's place fits 16 bits and sorts by radix.
CHUNK_ROWS = 1 << 15
#: Words of more bytes are hashed by XXH3: long runs of a polynomial modulo 2**64 have constructible collisions.
LONG_WORD = 256

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_NGRAM = _U(0xD6E8FEB86659FD93)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = splitmix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self._bases = [_U(base), _U(pow(base, -1, 1 << 64))]
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            with np.errstate(over="ignore"):
                self._tables = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)]), dtype=np.uint64) for b in self._bases]
        return self._tables[0][:n], self._tables[1][:n]


_POWERS = _Powers(_BASE)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def chunks(raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``size`` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(lo + CHUNK_ROWS, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers) from which ``span_hash`` reads the hash of any span of ``raw``."""
    power, inverse = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUE[raw] * power[: len(raw)], out=sums[1:])
    return sums, inverse


def span_hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        return splitmix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _NGRAM)


def byte_table(accept) -> np.ndarray:
    return np.array([bool(accept(b)) for b in range(256)])


#: Bytes that belong to words when words are runs of anything but ASCII white space.
NOT_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes that belong to words when words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words:
    """Words of a chunk: ``start``/``end`` byte spans, ``row`` of each, ``first`` word of each row (with the total at the
    end) and a 64-bit ``hash`` of each word, ASCII-lower-cased unless ``fold`` is off."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, accept: np.ndarray, fold: bool = True):
        inside = accept[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        lower = _LOWER[raw] if fold else raw
        self.hash = span_hash(*prefix_hash(lower), self.start, self.end)
        for i in np.flatnonzero(self.end - self.start > LONG_WORD):
            self.hash[i] = xxhash.xxh3_64_intdigest(lower[self.start[i] : self.end[i]].tobytes())

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``k`` words inside one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        out = np.full(len(at), k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * _NGRAM + self.hash[at + j]
        return at, splitmix(out)


def shingle_sets(words: Words, k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row edges): the distinct ``k``-word shingles of each row, sorted within the row.

    A row with fewer words, but not none, has its whole sequence as its one shingle.
    """
    counts = np.diff(words.first)
    parts = [words.ngrams(k)]
    for size in np.unique(counts[(counts > 0) & (counts < k)]):
        at, hashes = words.ngrams(int(size))
        whole = counts[words.row[at]] == size
        parts.append((at[whole], hashes[whole]))
    hashes = np.concatenate([h for _, h in parts])
    row = words.row[np.concatenate([a for a, _ in parts])].astype(np.uint16)
    order = np.argsort(hashes)
    order = order[np.argsort(row[order], kind="stable")]
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[fresh], row[fresh]
    return hashes, np.searchsorted(row, np.arange(rows + 1))


def window_reduce(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for every i; length len(x) - width + 1."""
    done = 1
    out = x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = op(out[:-rest], out[rest:])
    return out
