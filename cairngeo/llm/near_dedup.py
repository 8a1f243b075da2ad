"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct five-word shingles. Two permutations of the 32-bit integers make all
coordinates of a signature: the first places a shingle, the second, shifted circularly by one for each further
coordinate, ranks it; a coordinate is the least rank in the set. Bands of coordinates are hashed to buckets.
Copies (equal sets) are one class from the start, so buckets hold distinct sets only.

Within a bucket no list of all pairs is ever made. The set that meets the most others is compared with every other of
its bucket, links are confirmed on the full sets, and sets that are connected by then need no comparison with each
other. Where a bucket still holds sets of different components, those sets are compared if they share one of their
rarest shingles early enough, as similar sets must. So every similar pair that shares a bucket is either confirmed
or connected by other links, and a line that a third of all documents have makes no pairs by itself.

Defined results: texts without words have no shingles, are linked with nothing and are their own component; rows
without an id take no part (component null, kept); rows that repeat an id are judged by their own text, and one of
them stays; an empty table gives an empty result. Texts are read whole, and no bucket or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import chunks, fresh, text_buffer, written
from .words import U64, mix64, shingle_sets

PERCENT = 85
BANDS, ROWS = 25, 5  # a pair of similarity 0.85 shares no band with a chance of 4e-7
BLOCK = 1 << 16
U32 = np.uint32


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x ^= x >> U32(16)
    x *= U32(a)
    x ^= x >> U32(15)
    x *= U32(b)
    x ^= x >> U32(16)
    return x


def circulant_signatures(bounds: np.ndarray, shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates for each non-empty set shingles[bounds[i]:bounds[i + 1]]."""
    filled = np.flatnonzero(np.diff(bounds))
    first = bounds[filled]
    out = np.empty((len(filled), size), U32)
    place = _permute((shingles >> U64(32)).astype(U32), 0x7FEB352D, 0x846CA68B)
    begin = 0
    while begin < len(filled):
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + BLOCK)))
        block = place[first[begin] : bounds[filled[end - 1] + 1]]
        at, rank = first[begin:end] - first[begin], np.empty_like(block)
        for k in range(size):
            np.subtract(block, U32(k + 1), out=rank)
            out[begin:end, k] = np.minimum.reduceat(_permute(rank, 0x21F0AAAD, 0xD35A2D97), at)
        begin = end
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band; a key belongs to one band only."""
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=U64)), (len(signatures), bands)).copy()
    for r in range(rows):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + signatures[:, r : bands * rows : rows].astype(U64))
    return key.view(np.int64)


def set_digests(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """16 bytes for each non-empty set; equal sets have equal digests."""
    first = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(first), 2), U64)
    for k, seed in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        out[:, k] = np.add.reduceat(mix64(shingles ^ U64(seed)), first) if len(first) else 0
    return out.view(np.uint8).reshape(-1, 16)


def _optional_rows(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """Fixed-size rows of bytes as a binary array that is null where ``there`` is false."""
    ends = np.concatenate([[0], np.cumsum(there * values.shape[1])]).astype(np.int32)
    data = np.ascontiguousarray(values).reshape(-1)
    mask = pa.array(there).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(there), [mask, pa.py_buffer(ends), pa.py_buffer(data)])


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, print (hash of the text), n_shingles, digest of the set and band keys."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bounds, shingles = shingle_sets(*text_buffer(batch.column("text")))
            size = np.diff(bounds)
            keys = band_keys(circulant_signatures(bounds, shingles, bands * rows), bands, rows)
            ends = pa.array(np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("print"),
                    pa.array(size.astype(np.int64)),
                    _optional_rows(set_digests(bounds, shingles), size > 0),
                    pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1))),
                ],
                names=["id", "print", "n_shingles", "digest", "bands"],
            )

    taken = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return taken.mapInArrow(run, f"id {id_type}, print long, n_shingles long, digest binary, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a"):
            both = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]).dictionary_encode()
            bounds, shingles = shingle_sets(*text_buffer(both.dictionary))
            digest = [d.tobytes() for d in set_digests(bounds, shingles)]
            of = both.indices.to_numpy(zero_copy_only=False)
            left, right, wanted = of[: batch.num_rows], of[batch.num_rows :], []
            for i, (a, b, x, y) in enumerate(zip(left, right, batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if digest[a] == x and digest[b] == y:  # else another text under a repeated id
                    one, two = shingles[bounds[a] : bounds[a + 1]], shingles[bounds[b] : bounds[b + 1]]
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * common >= percent * (len(one) + len(two) - common):
                        wanted.append(i)
            yield batch.select(["a", "b"]).take(pa.array(wanted, pa.int64()))

    joined = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary").distinct()


def _feasible(n: str, m: str, percent: int):
    """Sets of these sizes can be that similar."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _rare_pairs(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``rest`` (digest, n, root) that may be that similar and have different roots.

    The shingles of a set are ordered by how many sets of ``rest`` have them, the rarest first. Two sets that are
    similar enough share one of their first shingles: of the smaller set n - ceil(2t / (1 + t) n) + 1, of the larger
    n - ceil(t n) + 1, and the first one they share lies early enough to leave the overlap that is needed. So
    a line or passage that many sets share makes no pairs, and no pair is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bounds, shingles = shingle_sets(*text_buffer(batch.column("text")))
            own = [d.tobytes() for d in set_digests(bounds, shingles)]
            filled = np.flatnonzero(np.diff(bounds))
            same = [int(i) for i, d in zip(filled, own, strict=True) if batch.column("digest")[int(i)].as_py() == d]
            sets = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(shingles.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([c.take(pa.array(same, pa.int64())) for c in (batch.column("digest"), sets)], names=["digest", "set"])

    mine = texts.join(rest.select("digest"), "digest", "left_semi").select("digest", "text")
    sets = mine.mapInArrow(run, "digest binary, set array<long>").dropDuplicates(["digest"])
    has = written(sets.select("digest", F.explode("set").alias("shingle")))
    often = has.groupBy("shingle").agg(F.count("*").alias("often"))
    by_set = Window.partitionBy("digest").orderBy("often", "shingle")
    placed = has.join(often, "shingle").select("digest", "shingle", "often", (F.row_number().over(by_set) - 1).alias("at")).join(rest, "digest")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    early = written(placed.where((F.col("often") > 1) & (F.col("at") < first)).drop("often"))
    smaller = early.where(F.col("at") < F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1)
    small = smaller.select("shingle", F.col("digest").alias("b"), F.col("n").alias("m"), F.col("root").alias("of"), F.col("at").alias("by"))
    before = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("digest")))
    enough = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("by")) >= percent * (F.col("n") + F.col("m"))
    able = before & (F.col("root") != F.col("of")) & _feasible("n", "m", percent) & enough
    return early.join(small, "shingle").where(able).select(F.least("digest", "b").alias("a"), F.greatest("digest", "b").alias("b")).distinct()


def links(classes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) that connect all similar classes. classes: digest, rep (id), n_shingles, bands."""
    bucket = Window.partitionBy("key")
    exploded = classes.select(F.explode("bands").alias("key"), "digest", F.col("n_shingles").alias("n"))
    shared = written(exploded.withColumn("size", F.count("*").over(bucket)).where(F.col("size") > 1))
    # The set that meets the most others is the center of its buckets: the original among its near copies.
    fame = shared.groupBy("digest").agg(F.sum("size").alias("fame"))
    ranked = bucket.orderBy(F.desc("fame"), "digest")
    centered = shared.join(fame, "digest").select("key", "digest", "n", F.first("digest").over(ranked).alias("center"), F.first("n").over(ranked).alias("m"))
    members = written(centered.where(F.col("digest") != F.col("center")))
    tested = members.where(_feasible("n", "m", percent)).select(F.least("center", "digest").alias("a"), F.greatest("center", "digest").alias("b"))
    tested = written(tested.distinct())
    reps = classes.join(shared.select("digest").distinct(), "digest", "left_semi").select("digest", "rep")
    texts = written(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(reps, "rep").select("digest", "text"))
    found = written(_confirmed(tested, texts, percent))

    roots = components(found).select(F.col("node").alias("digest"), "root")
    labelled = members.select("key", "digest", "n").join(roots, "digest", "left").select("key", "digest", "n", F.coalesce("root", "digest").alias("root"))
    unsettled = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = written(labelled.join(unsettled, "key", "left_semi").select("digest", "n", "root").distinct())
    if rest.isEmpty():
        return found
    pairs = written(_rare_pairs(rest, texts, percent).join(tested, ["a", "b"], "left_anti"))
    return written(found.unionByName(_confirmed(pairs, texts, percent)))


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept, print (hash of its text), digest (of its set).

    The component id is the smallest id reachable over links; the document that has it as its own id is kept.
    """
    signed = written(signatures(docs, bands, rows, id_col, text_col))
    named = signed.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = written(named.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    roots = components(links(classes, docs, percent, id_col, text_col))
    linked = classes.select("digest", "rep").join(roots.withColumnRenamed("node", "digest"), "digest")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    of = linked.join(least, "root").select("digest", "least")
    by_class = classes.select("digest", "rep").join(of, "digest", "left").select("digest", F.coalesce("least", "rep").alias("component_id"))
    out = signed.drop("bands").join(by_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), "print", "digest"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with the columns of ``docs``; rows without an id all stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept")
    of, by, row = fresh(docs, "kept_id", "kept_print", "kept_row")
    stay = found.groupBy(F.col(id_col).alias(of), "digest").agg(F.min("print").alias(by)).select(of, by).distinct()
    text = F.xxhash64(text_col)
    one = F.row_number().over(Window.partitionBy(of, by).orderBy(of))
    joined = docs.where(F.col(id_col).isNotNull()).join(stay, (F.col(id_col) == F.col(of)) & (text == F.col(by)))
    return joined.withColumn(row, one).where(F.col(row) == 1).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
