"""Word and shingle hashes over Arrow batches of texts, computed on whole batches with numpy.

A word is a run of bytes outside ASCII white space. Its hash is a polynomial over its bytes, a window's hash a
polynomial over its words' hashes, both modulo 2**64 and mixed afterwards. Nothing depends on the process, the batch
or the position in the corpus, so equal words and windows have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes, one text at least.
SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = 0xD6E8FEB86659FD93
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``size`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text; NULL is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, places, content = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(content or b"", np.uint8)[places[0]:places[-1]]
    places = places - places[0]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = places[:-1][places[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, places)).astype(np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    kept = data[inside].astype(np.uint64) + np.uint64(1 + seed)
    begin = (np.cumsum(inside) - 1)[starts]
    lengths = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, lengths)
    size = 1 << int(lengths.max()).bit_length()
    kept *= _powers(_BYTE, size)[place]
    return mix(np.add.reduceat(kept, begin) + lengths.astype(np.uint64) * np.uint64(_STEP + 2 * seed)), counts


def sliding(h: np.ndarray, k: int, base: int = _STEP) -> np.ndarray:
    """Hashes of all k consecutive values, also of those that cross texts; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, size, power, width = None, 0, h, 1
    while True:
        if k & width:
            if out is None:
                out, size = power, width
            else:
                n = len(h) - size - width + 1
                out = out[:n] + power[size:size + n] * np.uint64(pow(base, size, 1 << 64))
                size += width
        if 2 * width > k:
            break
        n = len(h) - 2 * width + 1
        power = power[:n] + power[width:width + n] * np.uint64(pow(base, width, 1 << 64))
        width *= 2
    return mix(out[:len(h) - k + 1])


def windows(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the word array at which a window of k words of one text starts, and their number for each text."""
    n = np.maximum(counts - k + 1, 0)
    ends = np.cumsum(n)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    return np.repeat(np.cumsum(counts) - counts, n) + within, n


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and their number; a shorter text that has words is one shingle."""
    h, counts = word_hashes(texts)
    padded = np.where(counts > 0, np.maximum(counts, k), 0)
    if not np.array_equal(padded, counts):
        full = np.full(int(padded.sum()), _MASK, np.uint64)
        at = np.cumsum(padded) - padded - (np.cumsum(counts) - counts)
        full[np.arange(len(h)) + np.repeat(at, counts)] = h
        h = full
    at, n = windows(padded, k)
    return sliding(h, k)[at], n


def sequence_keys(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole sequence of words; equal sequences have equal keys."""
    at = np.cumsum(counts) - counts
    place = np.arange(len(h)) - np.repeat(at, counts)
    size = 1 << (int(counts.max()) if len(counts) else 1).bit_length()
    out = []
    for base in (_STEP, _BYTE):
        terms = np.append(h * _powers(base, size)[place], np.uint64(0))
        total = np.where(counts > 0, np.add.reduceat(terms, np.minimum(at, len(h))), np.uint64(0))
        out.append(mix(total + counts.astype(np.uint64) * np.uint64(base)))
    return out[0], out[1]


def parts(values: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """The values of each text, given their numbers."""
    end = 0
    for k in n.tolist():
        yield values[end:end + k]
        end += k
