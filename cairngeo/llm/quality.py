"""Document quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives (labelled rows of quality 1) and unlabelled web text are all the learner sees, with an estimated
class prior p: the share of quality 1 among the labelled rows that may be learned from. The unbiased risk
p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)) with the logistic loss is minimised; where the
second term turns negative, its gradient is reversed instead, as the method asks. The features describe the shape
of a whole text: which kinds of characters follow each other, how words repeat, how long words and lines are.

The model is fitted on bounded samples (``sample`` positives and as many unlabelled rows, dealt by a hash of the
id); every document is then scored in one map without a shuffle.

Defined results: null and empty texts have the features of an empty text and get its score; rows without an id are
scored, never learned from; contradictory labels of one id count as not positive; without a positive row every
score is 0.5; an empty table gives an empty result. All columns of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import chunks, fresh, text_buffer, trainable
from .words import mix64, slices, word_hashes, words

SAMPLE = 6000
THRESHOLD = 0.3
CHUNK_BYTES = 2 << 20  # of text at a time, which bounds a worker's memory
BLOCK = 1 << 20

# Kinds of bytes, in natural order; all others are of kind 0.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",", b"!?", b":;", b"'\"`", b"()[]{}<>", b"|", b"#$%&*@", b"+-=/\\_^~"]
_KIND = np.zeros(256, np.uint8)
for _number, _members in enumerate(_KINDS):
    _KIND[list(_members)] = _number + 1
_KIND[128:] = 15
_SHAPES = 7
WIDTH = 256 + 16 + _SHAPES


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` numbers per text data[offsets[i]:offsets[i + 1]]."""
    texts = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((texts, WIDTH))
    if not len(data):
        return out
    kind = _KIND[data]
    pair = (kind[:-1] << 4) | kind[1:]
    two, one = np.zeros((texts, 256)), np.zeros((texts, 16))
    for i in np.flatnonzero(size):
        last = offsets[i + 1] - 1  # the pair that begins here reaches into the next text
        for begin in range(offsets[i], last, BLOCK):
            two[i] += np.bincount(pair[begin : min(begin + BLOCK, last)], minlength=256)
        one[i] = two[i].reshape(16, 16).sum(1)
        one[i, kind[last]] += 1
    long = np.maximum(size, 1)[:, None]
    out[:, :256] = np.sqrt(two / long)
    out[:, 256:272] = np.sqrt(one / long)

    start, end, text = words(offsets, data, data <= 0x20)
    if not len(start):
        return out
    hashes = word_hashes(slices(data, start, end))
    many = np.bincount(text, minlength=texts)
    n = np.maximum(many, 1)
    same = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    own = mix64(hashes ^ mix64(text.astype(np.uint64)))
    kept, where = np.unique(own, return_index=True)
    distinct = np.bincount(text[where], minlength=texts)
    followed = np.zeros(0, np.int64)
    if len(hashes) > 1:
        two_words = mix64(own[:-1] + hashes[1:])
        at = np.flatnonzero(text[1:] == text[:-1])
        _, first = np.unique(two_words[at], return_index=True)
        followed = np.bincount(text[at[first]], minlength=texts)
    else:
        followed = np.zeros(texts, np.int64)
    length = (end - start).astype(float)
    mean = np.bincount(text, length, texts) / n
    spread = np.sqrt(np.maximum(np.bincount(text, length**2, texts) / n - mean**2, 0))
    shape = out[:, 272:]
    shape[:, 0] = np.log1p(many)
    shape[:, 1] = distinct / n
    shape[:, 2] = followed / np.maximum(many - 1, 1)
    shape[:, 3] = np.bincount(text[1:][same], minlength=texts) / n
    shape[:, 4] = mean
    shape[:, 5] = spread
    shape[:, 6] = np.log1p(one[:, 5] / n)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> dict[str, np.ndarray | float]:
    """Weights of the linear model by Adam on the non-negative risk; the score is the sigmoid of its value."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-6] = np.inf  # constant in the sample: no information

    def ready(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -8, 8)

    p, u = ready(positive).astype(np.float32), ready(unlabelled).astype(np.float32)
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        # The logistic loss of label 1 has the derivative s - 1, that of label 0 has s.
        negative_risk = np.mean(np.log1p(np.exp(np.clip(u @ w + b, -30, 30)))) - prior * np.mean(np.log1p(np.exp(np.clip(p @ w + b, -30, 30))))
        gu, gp = su / len(u), prior * sp / len(p)
        pull = prior * (sp - 1) / len(p)
        if negative_risk >= 0:
            grad = np.append((pull - gp) @ p + gu @ u + decay * w, (pull - gp).sum() + gu.sum())
        else:
            grad = np.append(gp @ p - gu @ u, gp.sum() - gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {"w": w, "b": b, "mean": mean, "scale": scale}


def score(model: dict[str, np.ndarray | float] | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return _sigmoid(np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] + model["b"])


def _sampled(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Features of the documents with these ids (a bounded number), one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            rows = features(*text_buffer(batch.column("text"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in rows])], names=["id", "x"])

    id_type = docs.schema[id_col].dataType.simpleString()
    taken = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi")
    rows = taken.select("id", "text").mapInArrow(run, f"id {id_type}, x binary").dropDuplicates(["id"]).collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in sorted(rows, key=lambda r: str(r["id"]))], float).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """The model, or None without a positive row. Rows are picked by a hash of the id, ``sample`` of each kind at most."""
    marked = labels.where(trainable(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    share = marked.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not share:
        return None
    prior = min(max(share, 0.02), 0.98)
    positive = marked.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(sample).select("id")
    anyone = docs.where(trainable(F.col(id_col))).select(F.col(id_col).alias("id")).orderBy(F.xxhash64(F.lit("any"), "id"), "id").limit(sample)
    p, u = _sampled(docs, positive, id_col, text_col), _sampled(docs, anyone, id_col, text_col)
    return fit(p, u, prior) if len(p) and len(u) else None


def with_quality(docs: DataFrame, labels: DataFrame, out: str = "score", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the column ``out``: how likely a document is of quality 1, from 0 to 1."""
    docs = docs.drop(out)  # a column of that name is replaced
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **options))
    names, text_at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, CHUNK_BYTES):
            found = score(model.value, features(*text_buffer(batch.column(text_at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score at least ``threshold``, with the columns of ``docs``."""
    (name,) = fresh(docs, "quality_score")
    return with_quality(docs, labels, out=name, **options).where(F.col(name) >= threshold).select(*docs.columns)
