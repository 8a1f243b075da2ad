"""Periodic runs of words, found with an enhanced suffix array, and texts with every run cut to its first period.

A run is a stretch of words with smallest period q that no neighbouring word extends; it counts when it is at least
``min_repeats`` periods and ``min_words`` words long.

Many texts are worked on together. A word of one text is another symbol than the same word of the next, so the suffixes of
a text are neighbours in the suffix array and share no prefix with those of others. The array is sorted by prefix
doubling, where only suffixes that still tie are sorted again; the ranks of every doubling are kept and give the longest
common prefix of any two suffixes in a few steps. Each place of the LCP array splits its LCP interval in two; from the
smaller child every suffix i asks whether i + depth or i - depth lies in the other one, by its number in the inverse
suffix array. Such a pair is a branching tandem repeat: a square of period depth that the next word ends. The square
is rotated to the left as far as the text keeps the period, by the same ranks, which gives the run. Of runs of one stretch
the smallest period is kept. No tree is built, and nothing loops over words in Python; work is n log n in the
words of a text.

Defined results: null and empty texts and texts without words have no runs and collapse to an empty text; rows without an
id and repeated rows are worked on like any other; an empty table gives an empty result. Other columns pass through,
columns of the names asked for are replaced. A word that lies in several runs is dropped if any of them drops it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import chunks, text_buffer
from .words import slices, words

MIN_WORDS = 6
MIN_REPEATS = 4
PIECE_BYTES = 2 << 20  # texts worked on together; a longer text is a piece of its own
PAIRS = 1 << 21  # suffixes asked at once


def suffix_array(symbol: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks by the first 1, 2, 4, ... symbols while any tie).

    ``end`` is the end of the text of each position. Positions have one rank in ranks[j] if and only if their first
    2**j symbols are there and equal.
    """
    n = len(symbol)
    suffixes = np.argsort(symbol, kind="stable")
    sorted_ = symbol[suffixes]
    new = np.ones(n + 1, bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:n])
    rank = np.empty(n, np.int32)
    rank[suffixes] = np.maximum.accumulate(np.where(new[:n], np.arange(n, dtype=np.int32), 0))
    ties = np.flatnonzero(~(new[:n] & new[1:]))
    ranks, width = [], 1
    while len(ties):
        ranks.append(rank)
        at = suffixes[ties]
        behind = at + width
        second = np.where(behind < end[at], rank[np.minimum(behind, n - 1)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        suffixes[ties] = at
        new = np.ones(len(at) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new[:-1], ties, 0))
        ties = ties[~(new[:-1] & new[1:])]
        width *= 2
    return suffixes, rank, ranks


def common_prefix(ranks: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and at b, pair by pair (a is never b)."""
    length, last = np.zeros(len(a), np.int64), len(end) - 1
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        same = (x < end[a]) & (y < end[b])
        same &= ranks[j][np.minimum(x, last)] == ranks[j][np.minimum(y, last)]
        length += same.astype(np.int64) << j
    return length


def common_suffix(ranks: list[np.ndarray], first: np.ndarray, a: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """How many words before a equal those ``shift`` further on."""
    length = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x = a - length - (1 << j)
        inside = x >= first[a]
        x = np.maximum(x, 0)
        same = inside & (ranks[j][x] == ranks[j][np.minimum(x + shift, len(first) - 1)])
        length += same.astype(np.int64) << j
    return length


def children(lcp: np.ndarray, nodes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): node p splits the suffixes left..right - 1 into left..p - 1 and p..right - 1.

    left is the nearest place before p with a smaller LCP, right the nearest behind it with one that is not larger,
    found by halving steps over minima of 1, 2, 4, ... places.
    """
    n, minima = len(lcp), [lcp]
    while (1 << len(minima)) <= min(longest, n):
        half = 1 << (len(minima) - 1)
        wide = minima[-1].copy()
        np.minimum(wide[: n - half], minima[-1][half:], out=wide[: n - half])
        minima.append(wide)
    depth, left, right = lcp[nodes], nodes - 1, nodes + 1
    for j in range(len(minima) - 1, -1, -1):
        low = left - (1 << j) + 1
        skip = (low >= 0) & (minima[j][np.maximum(low, 0)] >= depth)
        left = np.where(skip, left - (1 << j), left)
        skip = (right + (1 << j) <= n) & (minima[j][np.minimum(right, n - 1)] > depth)
        right = np.where(skip, right + (1 << j), right)
    return left, right


def branching_squares(suffixes: np.ndarray, inverse: np.ndarray, lcp: np.ndarray, nodes: np.ndarray, first: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares at the nodes' depths that the word behind them ends."""
    left, right = children(lcp, nodes, longest)
    smaller_left = nodes - left <= right - nodes
    begin, size = np.where(smaller_left, left, nodes), np.where(smaller_left, nodes - left, right - nodes)
    low, high = np.where(smaller_left, nodes, left), np.where(smaller_left, right, nodes)
    starts, periods = [], []
    upto = np.cumsum(size)
    cut = 0
    while cut < len(nodes):
        stop = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + PAIRS)))
        own = size[cut:stop]
        of = np.repeat(np.arange(cut, stop), own)
        i = suffixes[begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)]
        depth = lcp[nodes[of]]
        for to, inside in ((i + depth, i + depth < end[i]), (i - depth, i - depth >= first[i])):
            number = inverse[np.clip(to, 0, len(inverse) - 1)]
            hit = inside & (number >= low[of]) & (number < high[of])
            starts.append(np.minimum(i, to)[hit])
            periods.append(depth[hit])
        cut = stop
    return np.concatenate(starts), np.concatenate(periods)


def runs(symbol: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the texts symbol[bounds[i]:bounds[i + 1]], by start and then period."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    if not len(symbol):
        return none, none, none
    text = np.repeat(np.arange(len(sizes)), sizes)
    first, end = bounds[:-1][text], bounds[1:][text]
    suffixes, inverse, ranks = suffix_array(text * (int(symbol.max()) + 1) + symbol, end)
    if not ranks:  # no word occurs twice in a text
        return none, none, none
    lcp = np.zeros(len(symbol), np.int64)
    neighbours = np.flatnonzero(ranks[0][suffixes[1:]] == ranks[0][suffixes[:-1]]) + 1
    lcp[neighbours] = common_prefix(ranks, end, suffixes[neighbours - 1], suffixes[neighbours])
    # A period of which the text can't hold enough repeats needs no look.
    nodes = neighbours[min_repeats * lcp[neighbours] <= sizes[text[suffixes[neighbours]]]]
    if not len(nodes):
        return none, none, none
    start, period = branching_squares(suffixes, inverse, lcp, nodes, first, end, int(sizes.max()))
    rotated = common_suffix(ranks, first, start, period)
    start, length = start - rotated, 2 * period + rotated
    enough = (length >= min_words) & (length >= min_repeats * period)
    start, length, period = start[enough], length[enough], period[enough]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(data: np.ndarray, start: np.ndarray, size: np.ndarray, count: np.ndarray) -> pa.Array:
    """The words data[start:start + size] as one text per ``count`` of them, joined by a space."""
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=out[1:])
    from_ = np.repeat(start - out[:-1], size + 1) + np.arange(out[-1])
    spaced = data[np.minimum(from_, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    spaced[out[1:] - 1] = 32
    edges = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=edges[1:])
    stop = out[edges[1:]] - (count > 0)  # without the space behind the last word
    begin = out[edges[:-1]]
    kept = np.ones(len(spaced), bool)
    kept[stop[count > 0]] = False
    offsets = np.zeros(len(count) + 1, np.int64)
    np.cumsum(stop - begin, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(spaced[kept])))


def collapsed(column: pa.Array, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> tuple[pa.Array, pa.Array]:
    """(runs, text) of each text: its runs, and its words without what repeats a run's first period."""
    offsets, data = text_buffer(column)
    begin, end, text = words(offsets, data, (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    symbol = slices(data, begin, end).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.searchsorted(text, np.arange(len(column) + 1))
    start, length, period = runs(symbol, bounds, min_words, min_repeats)
    change = np.bincount(start + period, minlength=len(symbol) + 1) - np.bincount(start + length, minlength=len(symbol) + 1)
    kept = np.cumsum(change)[: len(symbol)] == 0
    count = np.bincount(text[kept], minlength=len(column))
    texts = _joined(data, begin[kept], (end - begin)[kept], count)
    of = text[start] if len(start) else np.zeros(0, np.int64)
    fields = [pa.array(a, pa.int64()) for a in (start - bounds[of], length, period)]
    each = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
    edges = np.searchsorted(of, np.arange(len(column) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each), texts


def collapse_runs(
    docs: DataFrame,
    text_col: str = "text",
    out: tuple[str, str] = ("runs", "collapsed"),
    min_words: int = MIN_WORDS,
    min_repeats: int = MIN_REPEATS,
) -> DataFrame:
    """``docs`` with the runs (start, length, period) of each text, by start and period, and the text they leave."""
    docs = docs.drop(*out)
    carried = docs.columns
    names = [*carried, *out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, PIECE_BYTES):
            found, texts = collapsed(batch.column(text_col), min_words, min_repeats)
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, found, texts.cast(pa.string())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    shape = f"{fields}, `{out[0]}` array<struct<start:long,length:long,period:long>>, `{out[1]}` string"
    return docs.mapInArrow(run, shape)
