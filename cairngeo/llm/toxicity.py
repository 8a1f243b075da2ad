"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

The features of a document are the distinct words of its whole text and their first four and five bytes, hashed
to buckets. Buckets that tell toxic from other labelled documents and occur in ``least`` toxic ones are kept (``width`` of
them at most). Labels say
toxic or not; the toxic documents that are learned from are graded 1 to ``grades`` by how many kept features they
have (equal shares), all others are grade 0. The model is P(grade <= k) = sigmoid(t_k - w.x) with thresholds t_0 <
t_1 < ... and one weight vector for all of them. A document's severity is its expected grade, the sum of
P(grade > k); it is called toxic from P(grade > 0) = 0.5 on.

The model is fitted on a bounded sample of labelled rows (``sample``, dealt by a hash of the id); every document
is scored in one map without a shuffle.

Defined results: null and empty texts have no features; rows without an id are scored, never learned from;
of contradictory labels of one id the highest counts; without a toxic row to learn from every severity is 0; an
empty table gives an empty result. All columns of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import chunks, text_buffer, trainable, written
from .words import lowered, slices, words

SAMPLE = 20_000
WIDTH = 2048
GRADES = 3
LEAST = 5  # toxic documents of the sample that a feature must be in, however large the sample
MIN_LIFT = 2.0  # log of how much likelier a feature is in toxic documents
BUCKETS = 1 << 20
STEMS = (4, 5)  # bytes


def _buckets(word: bytes) -> list[int]:
    forms = [word, *(b"%d " % n + word[:n] for n in STEMS if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(f) % BUCKETS for f in forms]


def occurring(offsets: np.ndarray, data: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every distinct feature of every text, sorted; only ``wanted`` (a mask of the buckets) if given."""
    data = lowered(data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    start, end, text = words(offsets, data, ~letter)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = slices(data, start, end).dictionary_encode()
    table = np.full((len(coded.dictionary), 1 + len(STEMS)), -1, np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        found = _buckets(word)
        table[i, : len(found)] = found
    if wanted is not None:
        table[(table < 0) | ~wanted[table]] = -1
    code = coded.indices.to_numpy(zero_copy_only=False)
    some = (table >= 0).any(1)[code]
    pairs = table[code[some]]
    key = np.repeat(text[some], pairs.shape[1]) * BUCKETS + pairs.reshape(-1)
    key = np.unique(key[pairs.reshape(-1) >= 0])
    return key // BUCKETS, key % BUCKETS


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row: np.ndarray, column: np.ndarray, grade: np.ndarray, width: int, grades: int, rounds: int = 800, rate: float = 0.1, decay: float = 1e-5) -> dict[str, np.ndarray]:
    """Shared weights and ordered thresholds by Adam on the likelihood; x is 1 at (row, column)."""
    n = len(grade)
    share = np.array([(grade <= k).mean() for k in range(grades)]).clip(1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(width), [cut[0]], np.log(np.maximum(np.diff(cut), 1e-2))])  # gaps stay positive
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, rounds + 1):
        w, gaps = theta[:width], np.exp(theta[width + 1 :])
        t = theta[width] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, w[column], n)
        upper, lower = np.append(t, np.inf)[grade], np.append(-np.inf, t)[grade]
        a, b = _sigmoid(upper - z), _sigmoid(lower - z)
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p  # derivatives of log p by the upper and the lower threshold
        gz = (da - db) / n  # of the negative likelihood by z
        gt = np.zeros(grades)
        np.add.at(gt, grade[grade < grades], -da[grade < grades] / n)
        np.add.at(gt, grade[grade > 0] - 1, db[grade > 0] / n)
        after = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate([np.bincount(column, gz[row], width) + decay * w, [after[0]], after[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"w": theta[:width], "t": theta[width] + np.concatenate([[0], np.cumsum(np.exp(theta[width + 1 :]))])}


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, width: int = WIDTH, least: int = LEAST, grades: int = GRADES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> dict[str, np.ndarray] | None:
    marked = (
        labels.where(trainable(F.col(id_col)) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    taken = written(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id").select("text", F.col("y").cast("long").alias("y"))
    )

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in chunks(batches):
            text, bucket = occurring(*text_buffer(batch.column("text")))
            toxic = batch.column("y").to_numpy(zero_copy_only=False) > 0
            for k in (0, 1):
                seen[k] += np.bincount(bucket[toxic[text] == bool(k)], minlength=BUCKETS)
        found = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[0, found]), pa.array(seen[1, found])], names=["bucket", "clean", "toxic"])

    total, bad = taken.agg(F.count("*"), F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0))).first()
    if not bad or bad == total:
        return None
    rate = (F.col("toxic") + 0.1) / (bad + 0.2), (F.col("clean") + 0.1) / (total - bad + 0.2)
    lift = F.log(rate[0]) - F.log(rate[1])
    best = (
        taken.select("text", "y").mapInArrow(counts, "bucket long, clean long, toxic long")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= least)
        .select("bucket", lift.alias("lift"), (F.col("toxic") * lift).alias("weight"))
        .where(F.col("lift") > MIN_LIFT)
        .orderBy(F.desc("weight"), "bucket")
        .limit(width)
        .collect()
    )
    kept = np.sort(np.array([r["bucket"] for r in best], np.int64))
    wanted = np.zeros(BUCKETS, bool)
    wanted[kept] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            text, bucket = occurring(*text_buffer(batch.column("text")), wanted)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket)), batch.column("y")], names=["buckets", "y"])

    found = taken.select("text", "y").mapInArrow(rows, "buckets array<long>, y long").collect()
    hits = np.array([len(r["buckets"]) for r in found])
    toxic = np.array([r["y"] > 0 for r in found])
    borders = np.quantile(hits[toxic], np.arange(1, grades) / grades)
    grade = np.where(toxic, 1 + np.searchsorted(borders, hits, side="left"), 0)
    row = np.repeat(np.arange(len(found)), hits)
    column = np.searchsorted(kept, np.concatenate([np.array(r["buckets"], np.int64) for r in found]))
    model = fit(row, column, grade, len(kept), grades)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = model["w"]
    return {"weights": weights, "t": model["t"]}


def severity(model: dict[str, np.ndarray] | None, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """P(grade > k) for k = 0, 1, ...: one row per text."""
    texts = len(offsets) - 1
    if model is None:
        return np.zeros((texts, 1))
    text, bucket = occurring(offsets, data, model["weights"] != 0)
    z = np.bincount(text, model["weights"][bucket], texts)
    return 1 - _sigmoid(model["t"][None, :] - z[:, None])


def with_severity(docs: DataFrame, labels: DataFrame, out: tuple[str, str, str] = ("severity", "p_toxic", "toxic"), text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its expected grade, the probability of any grade above 0, and whether that is 0.5 or more."""
    docs = docs.drop(*out)  # a column of that name is replaced
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **options))
    names, text_at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            above = severity(model.value, *text_buffer(batch.column(text_at)))
            found = [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*names, *out])

    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(out, kinds, strict=True))]))
