"""Helpers shared by the corpus operators: written intermediate tables, the held-out split, batches of whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import files

# Texts are handed to the vectorised code in pieces of about this many bytes (one longer text is a piece of its own).
CHUNK_BYTES = 4 << 20


# Folders of the tables written since the innermost `passing_tables` began.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    if (folders := _passing.get()) is not None:
        folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that are written within, at the end; what is to last is taken out of the list or written after it."""
    folders: list[str] = []
    token = _passing.set(folders)
    try:
        yield folders
    finally:
        _passing.reset(token)
        for folder in folders:
            files.delete_tree(spark, folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learned from; a row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """True for rows that may be learned from: they have an id and are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows into pieces whose texts take at most about ``limit`` bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(size)
        yield batch.slice(begin)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets as int64 array, data as uint8 array) of a text column; null is empty."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    if filled.offset:
        filled = pa.concat_arrays([filled])
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]
