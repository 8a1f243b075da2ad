"""Words and word shingles of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SHINGLE = 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(offsets: np.ndarray, data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of the text) of each run of bytes that are not ``blank``; texts end a run."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~blank
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = np.zeros(len(data) + 1, bool)  # the position after a run
    last[1:] = inside[:-1] & (~inside[1:] | first[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings data[start:end], in order; they must not overlap."""
    size = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=size[1:])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(kept))])


def word_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash per string; equal strings are hashed once."""
    coded = strings.dictionary_encode()
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), U64, len(coded.dictionary))
    return found[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the distinct shingles of text i are hashes[bounds[i]:bounds[i + 1]], sorted.

    Words are runs without white space (0x20 and 0x09-0x0D), A-Z in lower case. A text of fewer than
    ``size`` words has its whole sequence as its one shingle, a text without words has none.
    """
    texts = len(offsets) - 1
    data = lowered(data)
    start, end, text = words(offsets, data, (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    if not len(start):
        return np.zeros(texts + 1, np.int64), np.zeros(0, U64)
    hashes = word_hashes(slices(data, start, end))
    count = np.bincount(text, minlength=texts)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    left = np.repeat(first + count, count) - np.arange(len(hashes))  # words from here to the end of the text
    chain = np.zeros(len(hashes), U64)
    for k in range(size):
        nxt = np.zeros(len(hashes), U64)
        nxt[: len(hashes) - k] = hashes[k:] if k else hashes
        chain = np.where(left > k, mix64(chain * U64(0x9E3779B97F4A7C15) + nxt + U64(k + 1)), chain)
    whole = (left >= size) | ((np.arange(len(hashes)) == first[text]) & (count[text] < size))
    chain, text = chain[whole], text[whole]
    order = np.lexsort((chain, text))
    chain, text = chain[order], text[order]
    new = np.ones(len(chain), bool)
    new[1:] = (chain[1:] != chain[:-1]) | (text[1:] != text[:-1])
    chain, text = chain[new], text[new]
    return np.searchsorted(text, np.arange(texts + 1)), chain
