"""Small mutable tables kept as whole Parquet versions.

Parquet has no MERGE. A change writes the next version in its own folder, and
readers take the newest one that has its success mark, so a writer that is lost
half way leaves the table as it was. A version is kept for an hour after the next
one took its place, however many follow, so a scan that began on it can end. One
writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources import files

KEPT_SECONDS = 3600


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, kept_seconds: float = KEPT_SECONDS):
        self.spark, self.path, self.schema, self.kept_seconds = spark, path.rstrip("/"), schema, kept_seconds

    def _versions(self) -> list[int]:
        names = files.children(self.spark, self.path)
        numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
        return [n for n in numbers if files.exists(self.spark, f"{self._folder(n)}/_SUCCESS")]

    def _folder(self, number: int) -> str:
        return f"{self.path}/v{number:08d}"

    def newest(self) -> str | None:
        """Folder of the newest version."""
        versions = self._versions()
        return self._folder(versions[-1]) if versions else None

    def read(self) -> DataFrame:
        """The newest version, empty before the first write."""
        folder = self.newest()
        if folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(folder)

    def adopt(self, folder: str) -> None:
        """Take files that are written already as the next version; without any, an empty one."""
        versions = self._versions()
        number = versions[-1] + 1 if versions else 1
        files.delete_tree(self.spark, self._folder(number))  # of a writer that was lost
        if files.exists(self.spark, folder):
            files.move(self.spark, folder, self._folder(number))
            files.touch(self.spark, f"{self._folder(number)}/_SUCCESS")
        else:
            self.spark.createDataFrame([], self.schema).write.parquet(self._folder(number))
        self._forget(versions, number)

    def replace(self, rows: DataFrame) -> None:
        """Write the next version; ``rows`` may read the current one."""
        versions = self._versions()
        number = versions[-1] + 1 if versions else 1
        names = self.schema.fieldNames()
        typed = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields])
        typed.select(*names).write.mode("overwrite").parquet(self._folder(number))
        self._forget(versions, number)

    def _forget(self, versions: list[int], number: int) -> None:
        """Delete the versions whose place was taken long enough ago."""
        for old, following in zip(versions, [*versions, number][1:], strict=True):
            if files.age_of(self.spark, f"{self._folder(following)}/_SUCCESS") > self.kept_seconds:
                files.delete_tree(self.spark, self._folder(old))

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        """Replace the rows that share a key with a new one, add the others."""
        from .ledger import upserted

        names = self.schema.fieldNames()
        self.replace(upserted(self.read().select(*names), rows.select(*names), keys))
