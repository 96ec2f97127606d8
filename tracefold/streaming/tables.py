"""Tables that a stream keeps current: a base, the changes since, and a pointer to the version that counts.

A batch writes its changes as one folder and then names it in a new pointer file; readers see either all of a batch or nothing
of it.  After some batches base and changes are merged into a new base.  Folders that no pointer names, such as those of
a run that died half-way, are ignored, and written over when the batch is repeated.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "__batch"


class Files:
    """The few file operations a pointer needs, through Hadoop, so that any store Spark can write to will do."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path, self.root = jvm.org.apache.hadoop.fs.Path, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole file under its name, or no file: written aside, then renamed."""
        aside = self._at(f"{name}.tmp")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._at(name)
        if self._fs.exists(target):
            self._fs.delete(target, False)
        if not self._fs.rename(aside, target):
            raise OSError(f"cannot publish {target.toString()}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class CurrentTable:
    """One row per key: the last by ``order`` of all changes applied.

    Without ``order`` later batches win, and a batch may hold a key once.  ``compact_after`` bounds the folders a read has
    to merge; ``keep`` is the number of versions that stay readable beside the newest.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str] | None = None, compact_after: int = 8, keep: int = 1):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.order = list(order) if order else [BATCH]
        self.compact_after, self.keep = compact_after, keep
        self.files = Files(spark, self.path)

    # -- versions --

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json")]

    def _pointer(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        return json.loads(self.files.read(f"versions/{known[-1] if version is None else version:012d}.json"))

    def batch(self) -> int:
        """The last batch that counts; -1 before the first."""
        pointer = self._pointer()
        return -1 if pointer is None else pointer["batch"]

    # -- reading --

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of the newest version, or of an older one that is still kept."""
        pointer = self._pointer(version)
        if pointer is None:
            raise ValueError(f"{self.path} holds no version {'' if version is None else version}".rstrip())
        return self._merged(pointer).drop(BATCH)

    def _merged(self, pointer: dict) -> DataFrame:
        folders = ([pointer["base"]] if pointer["base"] else []) + pointer["changes"]
        schema = T.StructType.fromJson(pointer["schema"])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])
        if len(folders) == 1:
            return rows  # a folder holds a key once
        return self._last(rows)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last row per key.  A null order comes before all others; of equal ones the later batch wins."""
        rest = [c for c in rows.columns if c not in self.key]
        at = F.struct(*[c for c in (*self.order, BATCH) if c in rows.columns])
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), at).alias("__row")).select(*self.key, "__row.*")

    # -- writing --

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Merge a batch of changes.  A batch that counts already is skipped, so a repeated one does no harm."""
        pointer = self._pointer() or {"batch": -1, "base": None, "changes": []}
        if batch <= pointer["batch"]:
            return
        rows = changes.withColumn(BATCH, F.lit(batch).cast("long"))
        if self.order != [BATCH]:
            rows = self._last(rows)
        rows = rows.select(*self.key, *[c for c in rows.columns if c not in self.key])
        name = f"changes-{batch:012d}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        pointer |= {"batch": batch, "changes": [*pointer["changes"], name], "schema": rows.schema.jsonValue()}
        if len(pointer["changes"]) >= self.compact_after:
            pointer = self._compacted(pointer)
        self.files.publish(f"versions/{batch:012d}.json", json.dumps(pointer))
        self._drop_old()

    def _compacted(self, pointer: dict) -> dict:
        name = f"base-{pointer['batch']:012d}"
        self._merged(pointer).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return pointer | {"base": name, "changes": []}

    def _drop_old(self) -> None:
        """Remove pointers beyond those kept, and then the folders that none names."""
        known = self.versions()
        for version in known[:-1 - self.keep]:
            self.files.remove(f"versions/{version:012d}.json")
        named = set()
        for version in known[-1 - self.keep:]:
            pointer = self._pointer(version)
            named |= {pointer["base"], *pointer["changes"]}
        for folder in self.files.names(""):
            if folder.startswith(("base-", "changes-")) and folder not in named:
                self.files.remove(folder)

