"""Repeated passages by hashing of units: sentences, lines or paragraphs.

A text is cut into units. Paragraphs lie between blank lines, lines between line breaks; a sentence is the part of a line
up to its full stop, question or exclamation mark (of any of the scripts in ``STOPS``), which finds passages that begin
and end within a line as well. A unit is normalised (A-Z in lower case, runs of white space as one space) and hashed to
128 bits; digests are grouped over all documents, with a partial step before the shuffle. The earliest ranked occurrence
(smallest id, then smallest offset) of a unit stays, others are repeats. Repeats that follow one another without a
gap are a passage; a passage of at least ``min_words`` words is removed, shorter ones are chance or a common phrase and
stay. In scripts that are written without spaces (``UNSPACED``) every character counts as a word, as do the runs between
white space elsewhere. The offsets of what is removed are those of the original text.

A digest that makes up a thousandth of all units or more is met by a broadcast of its first occurrence (there are fewer than
two thousand such digests), so that no task gets all its occurrences; the others are met by a shuffle.

Defined results: null text stays null, empty text empty; rows without an id come after all others; rows that
repeat an id are ranked by a hash of their text, equal rows with one id are one occurrence and keep or lose their units
together; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import chunks, fresh, written

MIN_WORDS = 25

# Full stops, question and exclamation marks of the scripts; scripts that are written without spaces
# (Thai to Khmer, kana, Chinese characters).
STOPS = ".!?。｡．！？।॥۔؟።፧၊။។"
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"

HEAVY = 1000  # a digest is frequent from this part of all units on

_SENTENCE = re.compile(f"[^{STOPS}\n]+[{STOPS}]*")
_UNSPACED = re.compile(f"[{UNSPACED}]")
_LINE = re.compile(r"[^\n]+")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]*\S[^\n]*)*")
_FOLDED = str.maketrans({**{chr(c): chr(c + 32) for c in range(65, 91)}, **dict.fromkeys("\t\n\r\x0b\x0c", " ")})
UNITS = {"sentence": _SENTENCE, "line": _LINE, "paragraph": _PARAGRAPH}


def units(text: str, kind: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text."""
    out = []
    for found in UNITS[kind].finditer(text):
        parts = list(filter(None, found.group().translate(_FOLDED).split(" ")))
        if parts:
            own = " ".join(parts)
            wide = 0 if own.isascii() else len(_UNSPACED.findall(own))
            out.append((*found.span(), max(len(parts), wide), xxhash.xxh3_128_digest(own)))
    return out


def occurrences(docs: DataFrame, kind: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit: digest, id, print (hash of the text) and number in the text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, number, digest = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = [u[3] for u in units(text or "", kind)]
                digest += own
                row += [i] * len(own)
                number += range(len(own))
            at = pa.array(row, pa.int64())
            columns = [pa.array(digest, pa.binary()), batch.column("id").take(at), batch.column("print").take(at), pa.array(number, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "id", "print", "number"])

    taken = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return taken.mapInArrow(run, f"digest binary, id {id_type}, print long, number int")


def repeats(found: DataFrame) -> DataFrame:
    """The occurrences that are not the first of their digest; ``found`` is a written table."""
    rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "print", "number")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first)
    frequent = F.col("n") >= max(2, found.count() // HEAVY)
    heavy = F.broadcast(first.where(frequent).select("digest", "first"))  # fewer than twice HEAVY rows
    rest = found.join(F.broadcast(first.where(frequent).select("digest")), "digest", "left_anti")
    met = found.join(heavy, "digest").unionByName(rest.join(first.where(~frequent).select("digest", "first"), "digest"))
    return met.where(rank != F.col("first")).drop("first")


def passages(own: list[tuple[int, int, int, bytes]], repeated: list[int], min_words: int) -> list[dict[str, int]]:
    """Spans of the stretches of consecutive repeated units that have at least ``min_words`` words.

    ``own`` are the units of a text, ``repeated`` the numbers of those that repeat, in order.
    """
    out, run = [], []
    for number in [*repeated, None]:
        if run and (number is None or number != run[-1] + 1):
            if sum(own[n][2] for n in run) >= min_words:
                out.append({"start": own[run[0]][0], "end": own[run[-1]][1]})
            run = []
        run.append(number)
    return out


def without(text: str, spans: list[dict[str, int]]) -> str:
    parts, at = [], 0
    for span in spans:
        parts.append(text[at : span["start"]])
        at = span["end"]
    return "".join([*parts, text[at:]])


def drop_repeats(
    docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", out: str = "removed"
) -> DataFrame:
    """``docs`` without repeated passages, and a column ``out`` of the spans taken from the original text, in order."""
    docs = docs.drop(out)  # a column of that name is replaced
    found = written(occurrences(docs, kind, id_col, text_col))
    of, by, repeated, done = fresh(docs, "span_of", "span_by", "span_units", "span_done")
    numbers = F.array_sort(F.collect_set("number")).alias(repeated)
    per_text = repeats(found).groupBy(F.col("id").alias(of), F.col("print").alias(by)).agg(numbers)
    text = F.col(text_col)
    joined = docs.join(per_text, (F.xxhash64(text_col) == F.col(by)) & F.col(id_col).eqNullSafe(F.col(of)), "left")

    @F.pandas_udf(f"text string, {out} array<struct<start:int,end:int>>")
    def cleaned(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        pairs = zip(texts, numbers, strict=True)
        spans = [[] if n is None else passages(units(t, kind), [int(k) for k in n], min_words) for t, n in pairs]
        kept = [t if t is None or not s else without(t, s) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame({"text": pd.Series(kept, dtype=object), out: pd.Series(spans, dtype=object)})

    both = joined.withColumn(done, cleaned(text, F.col(repeated)))
    return both.select(*[F.col(f"{done}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns], F.col(f"{done}.{out}").alias(out))
