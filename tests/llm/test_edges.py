"""Every operator and pipeline stage on odd rows and on empty tables."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from cairngeo.llm import decontamination, language, licences, line_dedup, near_dedup, neighbours, packing, passage_dedup, quality, toxicity

LABELS = [(4, 1, 0), (5, 1, 1), (6, 0, 0), (6, 1, 1), (None, 1, 1), (7, None, None), (99, 1, 0)]
ITEMS = [(1, "a line without an id that has words"), (2, None), (None, "short"), (3, ""), (3, "another text under a repeated id"), (3, "another text under a repeated id")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def operators(docs, labels, items):
    files = docs.selectExpr("doc_id", "concat(source, '/', doc_id, '.txt') as path", "text", "score as cosine")
    return {
        "near": near_dedup.near_duplicates(docs),
        "pack": packing.pack(docs),
        "quality": quality.with_quality(docs, labels),
        "toxicity": toxicity.with_severity(docs, labels),
        "leaks": decontamination.find_leaks(docs, items),
        "lines": line_dedup.drop_boilerplate(docs, min_sites=2, counts=("n_lines", "n_removed")),
        "passages": passage_dedup.drop_repeats(docs),
        "paragraphs": passage_dedup.drop_repeats(docs, kind="paragraph"),
        "licences": licences.licences(files),
        "language": language.with_language(docs),
    }


def test_odd_rows_keep_their_number(make, odd_rows, labels, items):
    docs = make(odd_rows)
    for name, df in operators(docs, labels, items).items():
        rows = df.collect()
        if name == "pack":
            assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r[0] for r in odd_rows)
        else:
            assert len(rows) == len(odd_rows), name


def test_empty_tables(make, labels, items):
    docs = make([])
    for name, df in operators(docs, labels.where("false"), items.where("false")).items():
        assert df.count() == 0, name


def test_empty_labels_and_benchmark(make, odd_rows, labels, items):
    docs = make(odd_rows)
    assert {r["score"] for r in quality.with_quality(docs, labels.where("false")).collect()} == {0.5}
    assert {r["severity"] for r in toxicity.with_severity(docs, labels.where("false")).collect()} == {0.0}
    assert decontamination.clean(docs, items.where("false")).count() == len(odd_rows)


@pytest.fixture(scope="module")
def sf(spark, make, odd_rows, labels, items, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    make(odd_rows).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_stage_on_odd_rows(spark, make, odd_rows, sf):
    docs = make(odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf)
        rows = found.collect()
        assert len(rows) >= 1, name
        if name != "packing":
            assert found.columns == docs.columns, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name


def test_one_row_of_repeated_rows_stays(spark, make, odd_rows, sf):
    left = near_dedup.deduplicated(make(odd_rows)).collect()
    assert Counter((r["doc_id"], (r["text"] or "")[:5]) for r in left if r["doc_id"] is not None) == Counter(
        [(1, ""), (2, ""), (3, "   \n "), (4, "word0"), (6, "short"), (8, "ÄÖÜ ß"), (8, "anoth")]
    )
    assert sum(r["doc_id"] is None for r in left) == 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, None), (6, [inf, 1.0]), (7, []), (8, [1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (10, [1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    found = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    got = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)}
    assert got[0] == [(1, 1, 1.0), (2, 10, 1.0), (3, 2, 0.5), (4, 20, -1.0)]
    assert [v for _, v, _ in got[20]] == [2, 0, 0, 1, 10]
    assert neighbours.nearest(vectors.where("false"), vectors.where("false")).count() == 0
