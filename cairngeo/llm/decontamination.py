"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, run once over each text.

Items and texts are normalised alike: A-Z in lower case, words are runs of digits, letters a-z and characters
beyond ASCII, one space between words. A window is ``window`` consecutive words of an item; an item of fewer
words is one window. The automaton walks the normalised text, a match is mapped to word numbers and from there
to character offsets of the original text.

The automaton is bounded: items are dealt into as many automata as their bytes need (``automaton_bytes`` of
item text each). Each further automaton is one more map over the same rows, so nothing is ever shuffled and
no broadcast grows with the benchmark.

Defined results: null and empty texts have no words and no hits; items without an id, a text or a word take no
part; an item id that occurs several times is one item with the windows of all its texts; repeated documents are
judged alike; an empty benchmark leaves every document clean. Every column of the input passes through.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import fresh

WINDOW = 10
AUTOMATON_BYTES = 2 << 20

# Digits and letters stay (A-Z as a-z), so does every byte beyond ASCII; the rest separates words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_UPPER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def _joined(words: list[bytes]) -> str:
    """One character per byte, each word between two spaces."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def _automaton(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton:
    owners: dict[str, set[str]] = defaultdict(set)
    sizes: dict[str, int] = {}
    for item, text in items:
        words = _words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            key = _joined(words[i : i + size])
            owners[key].add(item)
            sizes[key] = size
    found = ahocorasick.Automaton()
    for key, ids in owners.items():
        found.add_word(key, (sizes[key], tuple(sorted(ids))))
    found.make_automaton()
    return found


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton_of(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton:
    """Built once per Python worker; a worker keeps the last one only."""
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = _automaton(items, window)
    return _built[key]


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(intervals):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def scan(text: str, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, first and last word of each hit stretch, items found)."""
    words = _words(text)
    if not words or not len(automaton):
        return len(words), [], set()
    normal = _joined(words)
    intervals, items, gaps = [], set(), None
    for end, (size, ids) in automaton.iter(normal):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(gaps, end)) - 1
        intervals.append((last - size + 1, last))
        items.update(ids)
    return len(words), _merged(intervals), items


def _offsets(text: str, hits: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets in the original text, end exclusive."""
    places = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
    return [{"start": places[a][0], "end": places[b][1]} for a, b in hits]


def _item_groups(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in groups of about ``limit`` bytes of text, one group in the driver's memory at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna().distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // limit) or 1
    for group in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == group).collect()
        yield sorted((r["item"], r["text"]) for r in rows)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    automaton_bytes: int = AUTOMATON_BYTES,
    out: str = "leaks",
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, hits (first and last word of a stretch), spans (characters), items.

    Hits and spans are merged stretches in text order; items are sorted as strings.
    """
    docs = docs.drop(out)  # a column of that name is replaced
    text_at = docs.columns.index(text_col)
    leaks = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hits", T.ArrayType(_SPAN)),
            T.StructField("spans", T.ArrayType(_SPAN)),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct([("n_words", pa.int64()), ("hits", spans), ("spans", spans), ("items", pa.list_(pa.string()))])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, leaks)])
    spark, names = docs.sparkSession, docs.columns
    result = docs
    for number, group in enumerate(_item_groups(benchmark, item_col, item_text_col, automaton_bytes)):
        items = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], items=items, later=number > 0) -> Iterator[pa.RecordBatch]:
            automaton = None
            for batch in batches:
                automaton = automaton or _automaton_of(items.value, window)
                before = batch.column(batch.num_columns - 1).to_pylist() if later else [None] * batch.num_rows
                rows = []
                for text, old in zip(batch.column(text_at).to_pylist(), before, strict=True):
                    n_words, hits, found = scan(text or "", automaton)
                    if old and old["hits"]:
                        hits = _merged(hits + [(h["start"], h["end"]) for h in old["hits"]])
                        found |= set(old["items"])
                    rows.append(
                        {
                            "n_words": n_words,
                            "hits": [{"start": a, "end": b} for a, b in hits],
                            "spans": _offsets(text, hits) if hits else [],
                            "items": sorted(found),
                        }
                    )
                columns = batch.columns[: len(names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*names, out])

        result = result.mapInArrow(run, schema)
    return result


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with the columns of ``docs``."""
    (name,) = fresh(docs, "leaks")
    return find_leaks(docs, benchmark, out=name, **options).where(F.size(f"{name}.hits") == 0).select(*docs.columns)
