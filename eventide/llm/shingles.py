"""Word shingles of whole texts, hashed in NumPy over a batch of documents at a time."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLE = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _random(256, 11)
_PLACE = _random(_TABLE, 12) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]


def _place(r: np.ndarray) -> np.ndarray:
    if not len(r) or r.max() < _TABLE:
        return _PLACE[r]
    return np.where(r < _TABLE, _PLACE[r % _TABLE], mix(r.astype(np.uint64)) | np.uint64(1))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of documents that lie end to end in ``data`` (UTF-8), and each
    document's number of words.  Words are runs of bytes other than blanks, A-Z lowered."""
    n_docs = len(starts) - 1
    solid = np.flatnonzero(~_BLANK[data])
    if not len(solid):
        return np.empty(0, np.uint64), np.zeros(n_docs, np.int64)
    first = np.empty(len(solid), bool)
    first[0] = True
    np.not_equal(np.diff(solid), 1, out=first[1:])
    at = np.searchsorted(solid, starts[:-1])
    first[at[at < len(solid)]] = True  # a document's first byte starts a word
    begin = np.flatnonzero(first)
    lengths = np.diff(np.append(begin, len(solid)))
    place = np.arange(len(solid)) - np.repeat(begin, lengths)
    words = np.add.reduceat(_LOWER_BYTE[data[solid]] * _place(place), begin)
    words = mix(words + lengths.astype(np.uint64) * _M1)
    ends = np.searchsorted(solid[begin], starts)
    return words, np.diff(ends)


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, end to end, and how many each has.

    A shingle is ``size`` words in a row; a document with fewer words has one, of all its words;
    one without words has none.
    """
    words, n = word_hashes(data, starts)
    n_docs = len(n)
    ends = np.cumsum(n)
    begins = ends - n
    factors = _random(size + 1, 13) | np.uint64(1)
    total = max(0, len(words) - size + 1)
    long_ = np.zeros(total, np.uint64)
    for j in range(size):
        long_ += words[j:j + total] * factors[j]
    long_ = mix(long_)
    sets, counts = [], np.zeros(n_docs, np.int64)
    for d in range(n_docs):
        k = int(n[d])
        if k >= size:
            own = np.sort(long_[begins[d]:ends[d] - size + 1])
            if len(own) > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
        elif k:
            own = mix((words[begins[d]:ends[d]] * factors[:k]).sum(keepdims=True) + factors[size:] * np.uint64(k))
        else:
            continue
        sets.append(own)
        counts[d] = len(own)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), counts


def minhash(hashes: np.ndarray, counts: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """Rows of ``coordinates`` minima, one row for each document that has shingles."""
    begins = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(begins), coordinates), np.uint64)
    if len(begins):
        flips, odd = _random(coordinates, seed), _random(coordinates, seed + 1) | np.uint64(1)
        for c in range(coordinates):
            out[:, c] = np.minimum.reduceat((hashes ^ flips[c]) * odd[c], begins)
    return out


def text_batches(column, most_bytes: int = 500_000):
    """(first row, last row + 1, bytes, starts) over an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1)
        yield a, z, data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]
        a = z
    pa.default_memory_pool().release_unused()  # workers live on; what a batch took goes back
