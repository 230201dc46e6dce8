"""Vectorized words and n-grams over the UTF-8 bytes of Arrow string arrays.

All functions see whole texts. Memory is bounded by ``LIMIT`` bytes of text at
a time, or by one document's words where a single document is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time.
LIMIT = 1 << 19

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Everything but space, tab, newline, vertical tab, form feed and carriage return.
SOLID = table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters and digits and every byte of a longer character.
ALNUM = table(lambda b: b >= 0x80 or chr(b).isalnum())
#: ASCII letters and every byte of a longer character.
LETTER = table(lambda b: b >= 0x80 or chr(b).isalpha())

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, LIMIT + 1), base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), off


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 * LIMIT) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch whose texts come to about ``limit`` bytes."""
    _, off = utf8(batch.column(column))
    i = 0
    while i < len(batch):
        j = max(int(np.searchsorted(off, off[i] + limit, "right")) - 1, i + 1)
        yield batch.slice(i, j - i)
        i = j


def fold_latin(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters that UTF-8 writes as C3 80 to C3 9E."""
    out = LOWER[raw]
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    out[upper] += 0x20
    return out


def segments(data: np.ndarray, off: np.ndarray, keep: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, last byte, first document, last document) of runs of documents; a long document is cut between words."""
    i, docs = 0, len(off) - 1
    while i < docs:
        j = max(int(np.searchsorted(off, off[i] + LIMIT, "right")) - 1, i + 1)
        lo, hi = int(off[i]), int(off[j])
        while hi - lo > LIMIT:
            end = lo + LIMIT
            while end < hi and keep[data[end]]:
                gap = np.flatnonzero(~keep[data[end : min(end + LIMIT, hi)]])
                end = end + int(gap[0]) if len(gap) else min(end + LIMIT, hi)
            yield lo, end, i, j
            lo = end
        yield lo, hi, i, j
        i = j


def word_spans(raw: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of kept bytes; no run crosses a document start."""
    inside = keep[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(folded: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    p, inverse = powers(len(folded) + 1)
    total = np.zeros(len(folded) + 1, U64)
    np.cumsum((folded.astype(U64) + U64(1)) * p[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64))


def spans(texts: pa.Array, keep: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: which documents, their bytes, where each starts (and the end), word begins, word ends, first word of each document (and the end)."""
    data, off = utf8(texts)
    for lo, hi, i, j in segments(data, off, keep):
        starts = np.append(np.maximum(off[i:j] - lo, 0), hi - lo)
        raw = data[lo:hi]
        begin, end = word_spans(raw, starts[:-1], keep) if hi > lo else (np.empty(0, np.int64),) * 2
        yield slice(i, j), raw, starts, begin, end, np.searchsorted(begin, starts)


def words(texts: pa.Array, keep: np.ndarray = SOLID, fold=LOWER.__getitem__) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each document the index of its first word (one more at the end)."""
    hashes, counts = [np.empty(0, U64)], np.zeros(len(texts), np.int64)
    for docs, raw, _, begin, end, edges in spans(texts, keep):
        if len(begin):
            hashes.append(span_hashes(fold(raw), begin, end))
            counts[docs] += np.diff(edges)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)])


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges; an empty run is 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return np.diff(total[edges])


class Lookup:
    """Membership of hashes, with values: one small table says no to nearly all of them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], (np.zeros(len(keys)) if values is None else values[order])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & U64(0xFFFF)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of x that are keys, and which keys they are."""
        at = np.flatnonzero(self.maybe[(x & U64(0xFFFF)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        hit = self.keys[k] == x[at]
        return at[hit], k[hit]
