"""Vectorized splitting and hashing of Arrow string columns, used inside tasks.

All functions take the raw UTF-8 bytes of many texts at once. Separators are ASCII, so bytes of
multi-byte characters are never cut.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Masks of the first n bytes of a little-endian word of eight.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Words longer than this are digested one by one.
LONG_WORD = 64

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that are no letters: everything in ASCII but A-Z and a-z.
NON_LETTER = np.ones(256, bool)
NON_LETTER[0x80:] = False
NON_LETTER[ord("A"):ord("Z") + 1] = False
NON_LETTER[ord("a"):ord("z") + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes (a longer text is a run of its own): first row, end row, bytes, offsets."""
    data, offs = buffers(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes that are no separators."""
    n = len(data)
    inside = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair: a chain of bijective mixes over its pieces of eight bytes, begun with its length,
    so words of one length up to eight never share a hash; longer ones do by chance alone. Very long words are digested with BLAKE2b. Lanes are independent: two of them are 128 bits."""
    n = ends - starts
    h = mix(n.astype(np.uint64) + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    if not len(n):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    pieces = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    h = mix(h ^ (pieces[starts] & _MASK[np.minimum(n, 8)]))
    left, done = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
    while len(left):
        h[left] = mix(h[left] ^ (pieces[starts[left] + done] & _MASK[np.minimum(n[left] - done, 8)]))
        done += 8
        left = left[n[left] > done]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return h


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What tells words of equal hash apart: the length of those up to eight bytes, where the hash can't be shared by two of a length, and the other lane's hash of longer ones."""
    n = ends - starts
    out = n.astype(np.uint64)
    long = np.flatnonzero(n > 8)
    out[long] = hashes(data, starts[long], ends[long], 1)
    return out


def text_spans(texts_of: np.ndarray, n: int) -> np.ndarray:
    """Offsets into a list of items sorted by text number."""
    return np.searchsorted(texts_of, np.arange(n + 1))


def sums_by(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Sum of values in each span."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[spans[1:]] - total[spans[:-1]]
