"""Folder listings through Spark's own file system layer."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none when the folder does not exist."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(where))


def name_of(path: str) -> str:
    """Last name of a path."""
    return path.rstrip("/").rsplit("/", 1)[-1]


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def age_of(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was last changed."""
    fs, where = _file_system(spark, path)
    return time.time() - fs.getFileStatus(where).getModificationTime() / 1000


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, where = _file_system(spark, source)
    _, to = _file_system(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(where, to):
        raise OSError(f"cannot move {source} to {target}")


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, where = _file_system(spark, path)
    fs.create(where, True).close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file."""
    fs, where = _file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """All of a small file."""
    fs, where = _file_system(spark, path)
    opened = fs.open(where)
    try:
        return bytes(opened.readAllBytes())
    finally:
        opened.close()


def delete_tree(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark shows it in file metadata."""
    fs, where = _file_system(spark, path)
    return fs.makeQualified(where).toString().rstrip("/")


def order_folders(spark: SparkSession, root: str) -> list[str]:
    """Order folders of a delivery root: those whose name does not start with a dot."""
    fs, where = _file_system(spark, root)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(name for name in names if not name.startswith("."))
