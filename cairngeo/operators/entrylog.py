"""Small mutable tables kept as a log of entries.

A change writes only its own rows, as one entry; a reader takes the newest row of each key. Entries are numbered and
never changed. ``FANOUT`` of them are folded into a run that covers their numbers, ``FANOUT`` runs into the next
base, so L changes of a row each write L rows, about L more in runs, and the whole table once in ``FANOUT``
squared changes.

Every folder's name tells the numbers that it covers, and only folders with a success mark count:

    base-<upto>                 everything up to a number, no deleted rows
    run-<from>-<upto>           the newest row of each key within those numbers
    entry-<number>-<unique>     one change

Readers take the highest base, runs above it, entries above those. A writer that is lost between a fold and the removal of
what it folded has changed nothing, one that is lost in the middle of a write leaves a folder without a mark. What was
folded is kept for an hour, so a scan that began on it can end. One writer at a time; numbers go up
from writer to writer.
"""

from __future__ import annotations

import functools
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from .versioned import KEPT_SECONDS

FANOUT = 64

MARKS = NUMBER, DELETED = "_number", "_deleted"


class EntryLog:
    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], fanout: int = FANOUT, kept_seconds: float = KEPT_SECONDS
    ):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.fanout, self.kept_seconds = fanout, kept_seconds
        marks = [T.StructField(NUMBER, T.LongType()), T.StructField(DELETED, T.BooleanType())]
        self.stored = T.StructType([*schema.fields, *marks])
        self._last: int | None = None
        self._open = 0  # entries that no run covers, as far as this writer knows

    # -- what is there

    def _marked(self, name: str) -> bool:
        return files.exists(self.spark, f"{self.path}/{name}/_SUCCESS")

    def _folders(self) -> tuple[int, dict[str, tuple[int, int]], dict[str, int]]:
        """(base's number or -1, runs with what they cover, entries with their numbers) that count together.

        Marks are looked up from the widest folders down, so not for what these cover.
        """
        spans: dict[str, list[tuple[int, int, str]]] = {"base": [], "run": [], "entry": []}
        for name in files.children(self.spark, self.path):
            kind, *numbers = name.split("-")
            if kind in spans:
                first = int(numbers[0])
                spans[kind].append((first, int(numbers[1]) if kind == "run" else first, name))
        base = next((first for first, _, name in sorted(spans["base"], reverse=True) if self._marked(name)), -1)
        runs = {name: (first, upto) for first, upto, name in spans["run"] if first > base and self._marked(name)}
        covered = max([base, *(upto for _, upto in runs.values())])
        return base, runs, {name: first for first, _, name in spans["entry"] if first > covered and self._marked(name)}

    def _parts(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*[f"{self.path}/{n}" for n in names])

    def _order(self) -> Column:
        """What makes a row of a key newer than another."""
        return F.col(NUMBER)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key, deleted ones too."""
        whole = F.struct(*self.stored.fieldNames())
        return rows.groupBy(*self.keys).agg(F.max_by(whole, self._order()).alias("_row")).select("_row.*")

    def _kept(self, rows: DataFrame) -> DataFrame:
        """The newest rows that are in the table."""
        return rows.filter(~F.col(DELETED))

    def read(self) -> DataFrame:
        """The table as it is now: empty before the first entry."""
        base, runs, entries = self._folders()
        names = [*([f"base-{base:020d}"] if base >= 0 else []), *runs, *entries]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self._parts(names)
        if runs or entries:
            rows = self._kept(self._newest(rows))
        return rows.select(*self.schema.fieldNames())

    # -- changes

    def _number(self) -> int:
        """A number above all that were given: the time in microseconds, or one more than the last."""
        if self._last is None:
            base, runs, entries = self._folders()
            self._last = max([base, *(upto for _, upto in runs.values()), *entries.values()])
        self._last = max(self._last + 1, time.time_ns() // 1000)
        return self._last

    def _write(self, rows: DataFrame, number: int, deleted: bool, name: str) -> None:
        typed = [rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self._put(rows.select(*typed, F.lit(number).cast("long").alias(NUMBER), F.lit(deleted).alias(DELETED)), name)

    def _put(self, rows: DataFrame, name: str) -> None:
        """Write a folder; one of its name can only be there without a mark, of a writer that was lost."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _enter(self, rows: DataFrame, deleted: bool) -> None:
        number = self._number()
        self._write(rows, number, deleted, f"entry-{number:020d}-{uuid.uuid4().hex}")
        self._open = self._open + 1 if self._open else len(self._folders()[2])  # a new writer looks what is there
        if self._open >= self.fanout:
            self._fold()

    def upsert(self, rows: DataFrame) -> None:
        """Replace the rows that share a key with a new one, add the others. Keys are unique among ``rows``."""
        self._enter(rows, False)

    def delete(self, keys: DataFrame) -> None:
        """Forget the rows of these keys."""
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys]
        self._enter(keys.select(*self.keys, *rest), True)

    def replace(self, rows: DataFrame) -> None:
        """The table is these rows from now on; they may read what it was."""
        number = self._number()
        self._write(rows, number, False, f"base-{number:020d}")
        self._open = 0
        self._forget()

    # -- folding

    def _fold(self) -> None:
        """Entries into a run, runs into a base, once there are enough; then remove what was folded long ago."""
        base, runs, entries = self._folders()
        if len(entries) >= self.fanout:
            span = min(entries.values()), max(entries.values())
            self._put(self._newest(self._parts(list(entries))), f"run-{span[0]:020d}-{span[1]:020d}")
            base, runs, entries = self._folders()
        if len(runs) >= self.fanout:
            upto = max(last for _, last in runs.values())
            names = [*([f"base-{base:020d}"] if base >= 0 else []), *runs]
            self._put(self._kept(self._newest(self._parts(names))), f"base-{upto:020d}")
        self._open = 0
        self._forget()

    def _forget(self) -> None:
        """Delete the folders whose place a base or run took long enough ago, and those that have no mark."""
        base, runs, entries = self._folders()
        covers = [(span, name) for name, span in runs.items()]
        if base >= 0:
            covers.append(((-1, base), f"base-{base:020d}"))
        since = {name: files.age_of(self.spark, f"{self.path}/{name}/_SUCCESS") for _, name in covers}
        for name in files.children(self.spark, self.path):
            if name in since or name in entries or files.age_of(self.spark, f"{self.path}/{name}") <= self.kept_seconds:
                continue
            number = int(name.split("-")[1])
            over = [since[cover] for (first, upto), cover in covers if first <= number <= upto]
            if max(over, default=0.0) > self.kept_seconds or not self._marked(name):
                files.delete_tree(self.spark, f"{self.path}/{name}")


class LatestLog(EntryLog):
    """The newest row of each key by a time column, at equal times the one with the lowest ``tie``.

    Which row is newest does not depend on when it was entered, so entries may come late, twice or in any order. A key
    goes once its row is older than ``expiry`` before the newest row of the table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, time_col: str, tie: str, expiry: str | None, **options):
        super().__init__(spark, path, schema, [key], **options)
        self.time_col, self.tie, self.expiry = time_col, tie, expiry

    def _order(self) -> Column:
        return F.struct(F.unix_micros(F.col(self.time_col).cast("timestamp")), -F.col(self.tie))

    def _kept(self, rows: DataFrame) -> DataFrame:
        if self.expiry is None:
            return rows
        last = self.newest_time()
        return rows if last is None else rows.filter(F.col(self.time_col) > F.lit(last) - F.expr(f"INTERVAL {self.expiry}"))

    def newest_time(self):
        """The newest time of the table, from one column of its folders."""
        base, runs, entries = self._folders()
        names = [*([f"base-{base:020d}"] if base >= 0 else []), *runs, *entries]
        if not names:
            return None
        kind = self.schema[self.time_col].dataType
        return self._parts(names).agg(F.max(self.time_col).cast(kind).alias("t")).first()["t"]

    def read(self) -> DataFrame:
        """The table as it is now."""
        base, runs, entries = self._folders()
        if base >= 0 and not runs and not entries:
            return self._kept(self._parts([f"base-{base:020d}"])).select(*self.schema.fieldNames())
        return super().read()


class SentLog(EntryLog):
    """A set of rows that only grows, in parts, with a summary per folder of what it may hold.

    A summary is a bitmap of the hashes of one column (``BITS`` bits, 8 kB). A batch opens the folders whose bitmap
    meets its own, and of these the parts that its rows fall into; a folder without a summary is opened.
    """

    BITS = 1 << 16

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], by: str, parts: int, **options):
        super().__init__(spark, path, schema, keys, **options)
        self.by, self.parts = by, parts
        self._summaries: dict[str, int] = {}

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.parts)).cast("int")

    def _put(self, rows: DataFrame, name: str) -> None:
        where = f"{self.path}/{name}"
        rows.withColumn("_part", self.part()).write.mode("overwrite").partitionBy("_part").parquet(where)
        held = self.summary(self._parts([name]))
        files.write_bytes(self.spark, f"{where}/_summary", held.to_bytes(self.BITS // 8, "little"))
        self._summaries[name] = held

    def _parts(self, names: list[str]) -> DataFrame:
        read = self.spark.read.schema(T.StructType([*self.stored.fields, T.StructField("_part", T.IntegerType())]))
        whole = [read.option("basePath", f"{self.path}/{n}").parquet(f"{self.path}/{n}") for n in names]
        return functools.reduce(DataFrame.unionByName, whole)

    def summary(self, rows: DataFrame) -> int:
        """The bits of the rows, as a number; two bitmaps of 4 kB come to the driver."""
        bit = F.pmod(F.xxhash64(F.lit("bit"), self.by), F.lit(self.BITS)) + 1
        maps = rows.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        width = 8 * 4096
        return sum(int.from_bytes(r["bits"], "little") << (r["n"] - 1) * width for r in maps.collect())

    def _summary_of(self, name: str) -> int:
        if name not in self._summaries:
            where = f"{self.path}/{name}/_summary"
            held = files.read_bytes(self.spark, where) if files.exists(self.spark, where) else None
            self._summaries[name] = -1 if held is None else int.from_bytes(held, "little")
        return self._summaries[name]

    def folders_for(self, rows: DataFrame, apart_from: str | None = None) -> list[str]:
        """The folders that may hold rows with the values of ``by`` that these rows have."""
        base, runs, entries = self._folders()
        names = [*([f"base-{base:020d}"] if base >= 0 else []), *runs, *entries]
        self._summaries = {n: held for n, held in self._summaries.items() if n in names}
        wanted = self.summary(rows)
        return [n for n in names if n != apart_from and self._summary_of(n) & wanted]

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Enter the rows that are not in the set yet. A batch that comes again takes the place of its own entry."""
        name = f"entry-{batch_id + 1:020d}-batch"
        rows = rows.select(*self.schema.fieldNames())
        found = self.folders_for(rows, apart_from=name)
        if found:
            touched = [r[0] for r in rows.select(self.part().alias("p")).distinct().collect()]  # self.parts at most
            before = self._parts(found).filter(F.col("_part").isin(touched)).select(*self.keys)
            rows = rows.join(before, functools.reduce(lambda a, b: a & b, [rows[c].eqNullSafe(before[c]) for c in self.keys]), "left_anti")
        self._write(rows, batch_id + 1, False, name)
        self._open = self._open + 1 if self._open else len(self._folders()[2])
        if self._open >= self.fanout:
            self._fold()
