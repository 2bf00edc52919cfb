"""A keyed table in hash buckets, of which an upsert reads and writes only those with changes.

A version of the table is a manifest: one small file that says in which folder each bucket lies. An upsert
merges the changed buckets into folders of their own and then writes the next manifest; that single file is the
commit. Until it is there readers see the version before, and what a cut-short run has left is not
seen by anyone. Two writers of one version cannot both commit: the second finds the manifest taken.

A bucket has about rows / buckets rows, whatever the keys, since a key has one row; choose the number so that
a bucket fits a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import quoted
from millrace.sources.sinks import upsert

_BUCKET = "__bucket"
_MANIFEST = "version bigint, bucket int, folder string, buckets int, columns string, note string"
#: The manifest row that stands for the table itself.
_TABLE = -1


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    schema: T.StructType
    folders: dict[int, str]


class BucketedTable:
    """The table below a folder; per key the last change wins, by `version` columns among changes of one upsert."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], version: Sequence[str] = ()):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), list(keys), list(version)

    def create(self, df: DataFrame, buckets: int = 64) -> None:
        """The first version, from rows in which a key may repeat."""
        first = Version(0, buckets, df.schema, {})
        self._write(first, upsert(df.limit(0), df, self.keys, self.order))

    def current(self) -> Version:
        """The last committed version."""
        try:
            found = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/*")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise ValueError(f"no table below {self.root}") from error
            raise
        last = found.where(F.col("version") == found.agg(F.max("version")).scalar()).collect()  # a row for each bucket
        table = next(r for r in last if r.bucket == _TABLE)
        folders = {r.bucket: r.folder for r in last if r.bucket != _TABLE}
        return Version(table.version, table.buckets, T.StructType.fromJson(json.loads(table.columns)), folders)

    def read(self) -> DataFrame:
        version = self.current()
        return self._rows(version, sorted(version.folders))

    def ensure(self, schema: T.StructType, buckets: int = 64) -> None:
        """Creates an empty table if there is none."""
        try:
            self.current()
        except ValueError:
            self._commit(Version(0, buckets, schema, {}))

    def upsert(self, changes: DataFrame) -> list[int]:
        """Merges the changes; returns the buckets that were rewritten. All others are neither read nor written."""
        return self.merge(changes, lambda old, new: upsert(old, new, self.keys, self.order))

    def merge(
        self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], note: str | None = None
    ) -> list[int]:
        """`how` makes the new rows of the changed buckets from their old rows and the changes.

        A note is committed with the version, in the same file: `note in table.notes()` then says whether
        these changes are in the table.
        """
        version = self.current()
        changes = changes.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in version.schema])
        touched = sorted(r[0] for r in changes.select(self._bucket(version)).distinct().collect())
        if touched or note is not None:
            old = self._rows(version, [b for b in touched if b in version.folders])
            self._write(version, how(old, changes).select(*version.schema.names), note)
        return touched

    def notes(self) -> set[str]:
        """The notes of all versions."""
        found = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/*")
        return {r.note for r in found.where(f"bucket = {_TABLE} AND note IS NOT NULL").select("note").collect()}

    def _bucket(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(*map(quoted, self.keys)), F.lit(version.buckets)).cast("int").alias(_BUCKET)

    def _rows(self, version: Version, buckets: Sequence[int]) -> DataFrame:
        paths = [f"{self.root}/{version.folders[b]}" for b in buckets]
        if not paths:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*paths)

    def _write(self, version: Version, merged: DataFrame, note: str | None = None) -> None:
        folder = f"data/{uuid.uuid4().hex}"
        # a bucket with more than a task's share of rows is written by several tasks, each its own file
        placed = merged.select("*", self._bucket(version)).hint("rebalance", F.col(_BUCKET))
        placed.write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
        new = {b: f"{folder}/{_BUCKET}={b}" for b in self._buckets_in(folder)}
        self._commit(replace(version, folders=version.folders | new), note)

    def _buckets_in(self, folder: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        entries = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [e.getPath().getName() for e in entries]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}="))

    def _commit(self, version: Version, note: str | None = None) -> None:
        """Writes the manifest that follows a version."""
        number = version.number + 1
        rows = [(number, b, f, version.buckets, None, None) for b, f in version.folders.items()]
        rows.append((number, _TABLE, None, version.buckets, version.schema.json(), note))
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.root}/manifest/v{number:09d}")
