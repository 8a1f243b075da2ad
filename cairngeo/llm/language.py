"""Language of a text by compression: the language whose dictionary makes the text smallest.

For each language a raw-content zstandard dictionary is filled with texts of that language. The words of a whole text,
in lower case, are cut into blocks of at most ``BLOCK`` bytes, so that the dictionary stays within the window and counts for
the end of a text as for its head. Every block is encoded by itself with every dictionary, and the language with the
smallest sum over all blocks is chosen. The margin is the share by which the second smallest sum is larger; where it is
narrow, the choice is marked as rejected. Texts that are null or have no letter (Unicode category L) are ``und``; marks
stay with their letters, numerals of any kind are no letters.

Dictionaries are filled from a bounded sample: about ``sample`` texts per language, dealt by a hash of the id, give an
excerpt of at most ``excerpt`` characters each, from a place that a hash chooses over the whole text, until the
dictionary has ``size`` bytes. There is one per language that occurs in the rows that may be learned from. Scoring is one
map without a shuffle.

Defined results: ties go to the language that sorts first; rows without an id are scored, never learned from; a
single known language gets margin 1; without any known language every text is ``und``; an empty table gives an empty
result. All columns of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import trainable

SAMPLE = 200
DICTIONARY_BYTES = 96 << 10
EXCERPT = 2000  # characters that one text gives to a dictionary
BLOCK = 8 << 10  # bytes that are encoded at once: a block learns little from itself, and lies far inside the window of 256 kB
NARROW = 0.02
UNKNOWN = "und"

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    """The words of a text in lower case with one space around each; nothing for a text without letters."""
    found = _OTHER.sub(" ", text.lower()).strip()
    return f" {found} ".encode() if _LETTER.search(found) else b""


def blocks(raw: bytes) -> list[bytes]:
    """All of ``raw`` in as few blocks of equal size as hold it."""
    size = -(-len(raw) // -(-len(raw) // BLOCK))
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def dictionaries(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES, excerpt: int = EXCERPT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language, from rows that may be learned from."""
    known = docs.where(trainable(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not count:
        return {}
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sorted(count.items()) for x in (lang, min(span, 2 * span * sample // n + 1))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(span)) < share[F.col("lang")])
    places = F.greatest(F.length("text") - excerpt, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64(F.lit("excerpt"), "id"), places).cast("int") + 1
    texts = drawn.select("lang", "id", F.substring(F.col("text"), begin, F.lit(excerpt)).alias("text")).orderBy(F.xxhash64("id"), "id", "text").limit(2 * sample * len(count) + 1000).collect()
    out: dict[str, bytes] = {}
    for lang in sorted(count):
        seen = dict.fromkeys(r["text"] for r in texts if r["lang"] == lang)
        out[lang] = b"".join(map(letters, seen))[:size]
    return {lang: content for lang, content in out.items() if content}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = sorted(contents)
        self.tools = []
        for lang in self.langs:
            held = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            setting = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False)
            held.precompute_compress(compression_params=setting)
            self.tools.append(zstandard.ZstdCompressor(dict_data=held, compression_params=setting))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, margin)"""
        raw = letters(text) if text and self.langs else b""
        if not raw:
            return UNKNOWN, 0.0
        parts = blocks(raw)
        sizes = np.array([sum(len(tool.compress(part)) for part in parts) for tool in self.tools])
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        return self.langs[best], float(1 - sizes[best] / rest.min()) if len(rest) else 1.0


def with_language(docs: DataFrame, out: tuple[str, str, str] = ("lang_pred", "score", "accepted"), narrow: float = NARROW, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the language, the margin (0 to 1), and whether the margin is at least ``narrow``."""
    docs = docs.drop(*out)  # a column of that name is replaced
    contents = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, text_col=text_col, **options))
    names, text_at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(contents.value)
        for batch in batches:
            found = [classify(text) for text in batch.column(text_at).to_pylist()]
            margin = np.array([m for _, m in found])
            columns = [pa.array([lang for lang, _ in found], pa.string()), pa.array(margin, pa.float64()), pa.array(margin >= narrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *out])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(out, kinds, strict=True))]))
