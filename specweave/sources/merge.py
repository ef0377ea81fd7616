"""Keyed tables that a batch changes in few places.

Rows lie in partitions by a hash of their key. ``merge`` reads and writes anew only the
partitions that a batch's keys belong to; the others keep their files. A manifest, written
last, says which folder holds each partition of a version and which batches it has, so a batch
that broke off midway leaves the table as it was and one that is done twice changes nothing.
Older versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Partitions of a table; a large one takes as many as keep a partition to some hundred MB.
PARTS = 64


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[str, str]
    batches: tuple[str, ...]


class KeyedTable:
    """A table below a folder with one row for each key. Null keys are keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, parts: int = PARTS) -> None:
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifest/v*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in fs.globStatus(at) or [])

    def version(self, number: int | None = None) -> Version:
        """A version, the newest if none is named."""
        there = self.versions()
        if not there:
            return Version(0, {}, ())
        row = json.loads(self.spark.read.text(f"{self.path}/manifest/v{number or there[-1]}").first()[0])
        return Version(row["number"], row["folders"], tuple(row["batches"]))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _read(self, v: Version, parts: list[int] | None = None) -> DataFrame:
        wanted = [f"{self.path}/data/{at}/part={p}" for p, at in v.folders.items() if parts is None or int(p) in parts]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        return self._read(self.version(number))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys: only partitions that hold them are read."""
        parts = [r[0] for r in keys.select(self._part().alias("p")).distinct().collect()]  # at most self.parts numbers
        return self._read(self.version(), parts).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def merge(self, rows: DataFrame, order: list[str] | None = None, batch: str | None = None, deleted: str | None = None) -> Version:
        """The table with rows in place of those of equal keys; rows whose column ``deleted`` is true take theirs away.

        Of several rows of one key the last in ``order`` counts; without an order they are compared
        column by column, so that it is always the same one.
        """
        old = self.version()
        if batch is not None and batch in old.batches:
            return old
        named = [f.name for f in self.schema]
        by = [F.col(c).desc_nulls_last() for c in order or [c for c in named if c not in self.keys] or self.keys]
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        new = rows.withColumn("__gone", gone).withColumn("__n", F.row_number().over(W.partitionBy(*self.keys).orderBy(*by))).where("__n = 1")
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], "__gone").withColumn("part", self._part())
        touched = [r[0] for r in rows.select(self._part().alias("p")).distinct().collect()]
        held = self._read(old, touched)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        kept = held.alias("o").join(new.select(*self.keys).alias("n"), condition, "left_anti").withColumn("part", self._part())
        at = uuid.uuid4().hex
        out = kept.select(*named, "part").unionByName(new.where("NOT __gone").select(*named, "part"))
        if touched:
            out.repartition(len(touched), "part").sortWithinPartitions("part", *self.keys).write.partitionBy("part").parquet(f"{self.path}/data/{at}")
        # a partition whose last row went has no folder any more
        fs, written = self._fs(f"{self.path}/data/{at}/part=*")
        there = {f.getPath().getName()[5:] for f in fs.globStatus(written) or []}
        folders = {p: f for p, f in old.folders.items() if int(p) not in touched} | dict.fromkeys(sorted(there, key=int), at)
        v = Version(old.number + 1, folders, (*old.batches, *([batch] if batch is not None else [])))
        line = json.dumps({"number": v.number, "folders": v.folders, "batches": v.batches})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v{v.number}")
        return v

    def vacuum(self) -> int:
        """Drop data that the newest version does not name, and older manifests; how many folders went."""
        newest = self.version()
        keep = {f"{at}/part={p}" for p, at in newest.folders.items()}
        n = 0
        for pattern, name in (("data/*/part=*", lambda p: f"{p.getParent().getName()}/{p.getName()}"), ("manifest/v*", lambda p: p.getName())):
            fs, at = self._fs(f"{self.path}/{pattern}")
            for f in fs.globStatus(at) or []:
                if name(f.getPath()) not in keep | {f"v{newest.number}"}:
                    n += bool(fs.delete(f.getPath(), True))
        return n
