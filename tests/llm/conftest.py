from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, `hit_of` string, score double, task int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) with extra columns whose names the operators use themselves."""

    def build(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "d", None, None, 7) for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"word{i % 977} more{i % 31}" for i in range(30_000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "   \n \t\n", "en", "a"),
        (4, words, "en", "b"),
        (5, words, "en", "b"),
        (5, words, "en", "b"),
        (None, "a line without an id that has words", None, "c"),
        (None, None, None, None),
        (6, "short", "en", None),
        (7, "short", "en", "d"),
        (8, "ÄÖÜ ß é ñ 日本 😀 <|endoftext|> \x00 x", "de", "e"),
        (8, "another text under a repeated id, long enough for shingles", "en", "e"),
    ]
