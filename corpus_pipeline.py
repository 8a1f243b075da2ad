"""The corpus pipeline: documents in, packed token sequences out.

Quality, boilerplate lines, near-duplicates, benchmark leaks, packing. Each stage works on all that its predecessor kept; between
the stages the documents lie as Parquet in the shared folder, so a stage that fails can be run again on its own
input. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngeo.llm import decontamination, line_dedup, near_dedup, packing, quality
from cairngeo.llm.tables import passing_tables, written
from cairngeo.session import configure
from cairngeo.sources import files


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    configure(spark)
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that many sites share; n_chars follows the text."""
    configure(spark)
    cleaned = line_dedup.drop_boilerplate(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cleaned if length is None else cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


#: Pairs of this similarity are near-duplicates; one shares no band with a chance of 7e-6 where no other way finds it.
NEAR_PERCENT, NEAR_BANDS = 80, 30


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, from a similarity of 0.8 on."""
    configure(spark)
    return near_dedup.deduplicated(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    configure(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left and their places in sequences."""
    configure(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier and the packing can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table.

    Once a stage's documents are written, the tables that it made on the way and its own input are deleted. The last
    stage's input and tables stay, as its rows are made when they are asked for.
    """
    configure(spark)
    sf_dir = sf_dir.rstrip("/")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with passing_tables(spark) as folders:
            docs = written(stage(spark, docs, sf_dir))
            kept = folders.pop()  # the last one written
        if before is not None:
            files.delete_tree(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
