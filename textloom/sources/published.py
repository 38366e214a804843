"""Tables that are published together: immutable Parquet folders, and one small file for each version.

A version's file names the folders of every table.  It is written whole beside its place and then given its name
only if no file has that name yet, in one step of the file system: of two publishers that began at one
version exactly one gets the next, and the other is told (`Conflict`).  Nothing that is read ever changes: a publisher
that dies before the last step leaves the old version as it was, and folders that no version names.

Rows are written by the executors.  The driver handles names of folders alone, and looks for the newest version from the last
one it knows.  A local folder takes a hard link as its last step, other file systems a rename that refuses to
replace; stores that cannot refuse need a file system that can.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.catalogue import upsert


class Conflict(RuntimeError):
    """Another publisher has taken the version."""


class Published:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("versions"))
        self._last = 0

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _file(self, version: int) -> str:
        return f"versions/{version:012d}.json"

    def version(self) -> int:
        """The newest version; 0 before the first."""
        while self._fs.exists(self._path(self._file(self._last + 1))):
            self._last += 1
        return self._last

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v == 0:
            return {"version": 0, "note": "", "tables": {}}
        stream = self._fs.open(self._path(self._file(v)))
        try:
            data = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(data)

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest if none is named; columns that a folder lacks are null."""
        paths = self.manifest(version)["tables"][table]
        if any(p.endswith(".by") for p in paths):  # folders with partitions of their own are read one by one
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(p) for p in paths])
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def stage(self, df: DataFrame | tuple[DataFrame, str]) -> str:
        """Writes rows to a folder of their own, which no version names yet; with the name of a column, partitioned by it."""
        rows, by = df if isinstance(df, tuple) else (df, None)
        path = f"{self.root}/data/{uuid.uuid4().hex}{'.by' if by else ''}"
        (rows.write.partitionBy(by) if by else rows.write).mode("errorifexists").parquet(path)
        return path

    def publish(self, base: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, note: str = "") -> int:
        """Version base + 1: that of `base` with some tables replaced and others added to, all at once or not at all.

        Raises Conflict if base is no longer the newest, before anything is written if that is known by then."""
        if self.version() != base:
            raise Conflict(f"version {base + 1} is taken")
        tables = dict(self.manifest(base)["tables"])
        tables |= {t: [self.stage(df)] for t, df in (replace or {}).items()}
        for t, df in (append or {}).items():
            tables[t] = [*tables.get(t, ()), self.stage(df)]
        self._commit(base + 1, json.dumps({"version": base + 1, "note": note, "tables": tables}, sort_keys=True, ensure_ascii=False))
        return base + 1

    def _commit(self, version: int, content: str) -> None:
        own, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(self._file(version))
        out = self._fs.create(own, False)
        out.write(bytearray(content.encode("utf-8")))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(own.toUri().getPath(), final.toUri().getPath())
                except FileExistsError:
                    raise Conflict(f"version {version} is taken") from None
            else:
                none = self._hadoop.Options.Rename.NONE
                array = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                array[0] = none
                try:
                    self._hadoop.FileContext.getFileContext(own.toUri(), self._conf).rename(own, final, array)
                except Exception as e:
                    if self._fs.exists(final):
                        raise Conflict(f"version {version} is taken") from e
                    raise
        finally:
            self._fs.delete(own, False)

    def update(self, make: Callable[[int], dict], attempts: int = 5) -> int:
        """Publishes what `make` says of the newest version (arguments of publish), anew after each conflict."""
        for left in range(attempts - 1, -1, -1):
            base = self.version()
            try:
                return self.publish(base, **make(base))
            except Conflict:
                if not left:
                    raise
        raise ValueError("no attempts")

    def upsert(self, table: str, new: DataFrame, keys: list[str], columns: list[str], order: str | None = None) -> int:
        """Rows of a key that is there get the listed columns of the incoming row, others are added; the table is made if there is none."""
        none = new.limit(0)
        return self.update(lambda v: {"replace": {table: upsert(self.read(table, v) if table in self.tables(v) else none, new, keys, columns, order)}, "note": f"upsert {table}"})

    def unnamed(self) -> list[str]:
        """Folders that no version names: of publishers that lost, died, or are not done yet."""
        named = {p.rsplit("/", 1)[1] for v in range(1, self.version() + 1) for ps in self.manifest(v)["tables"].values() for p in ps}
        data = self._path("data")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(data) if s.getPath().getName() not in named) if self._fs.exists(data) else []
