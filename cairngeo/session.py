"""Session settings shared by the library, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
TASKS_PER_CORE = 3  # of rows spread out


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The same as ``--py-files``, for sessions that were started without it.
    """
    context = spark.sparkContext
    if getattr(context, "_cairngeo_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    bundle = os.path.join(tempfile.mkdtemp(prefix="cairngeo-package-"), "cairngeo.zip")
    with zipfile.ZipFile(bundle, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(bundle)
    context._cairngeo_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on (all are session-level)."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")  # heeded by readers that ask for it, see layers.from_footers
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairngeo")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder made for it;
    a cluster without it is a configuration error, since a machine-local folder
    would be lost with its executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="cairngeo-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that each stand for much work, dealt out to all tasks, rows of equal ``keys`` to the same one.

    Adaptive execution sizes tasks by bytes and would join thousands of such rows in one; a stated number of partitions is kept.
    """
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder once."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
