"""Versioned tables in parts: a version names the folders that make up the table, and a write rewrites no more than the
parts that it touches.

A table has data (``data/v=<version>/part=<name>``) and manifests (``manifest/<version>.json``: part to folders). A
version exists once its manifest does, which is put in place by a rename; data without one belong to a write that did
not come to its end, and are replaced when it is repeated. Readers keep the version that they began with until ``vacuum``
removes it."""

from __future__ import annotations

import json
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PART = "part"


class Snapshots:
    """Tables under ``root``. Versions are numbers that rise; what a batch writes carries the batch's number, so that a
    repeated batch, which reads what was there before it, gives the same tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self, table: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/{table}/manifest") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, table: str, before: int | None = None) -> dict[str, list[str]]:
        """Part to folders, of the latest version or of the latest one before a number."""
        found = [v for v in self.versions(table) if before is None or v < before]
        if not found:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/{table}/manifest/{found[-1]}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, schema: str, before: int | None = None, parts: Collection[str] | None = None) -> DataFrame:
        """The latest version, or the latest one before a number; an empty table where there is none. With ``parts``
        only these are read."""
        found = self.manifest(table, before)
        folders = [f"{self.root}/{table}/{f}" for p, names in found.items() if parts is None or p in parts for f in names]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _publish(self, table: str, version: int, manifest: dict[str, list[str]]) -> None:
        final, draft = (self._path(f"{self.root}/{table}/manifest/{name}") for name in (f"{version}.json", f".{version}.draft"))
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        self._fs.delete(final, False)  # only where a batch is repeated: until the rename the version before it holds
        if not self._fs.rename(draft, final):
            raise OSError(f"version {version} of {table} could not be published")

    def _data(self, table: str, version: int, rows: DataFrame, part: Column) -> dict[str, list[str]]:
        to = f"{self.root}/{table}/data/v={version}"
        # Rows of a part lie together, but a large part is written by many tasks.
        rows.withColumn(_PART, part).hint("rebalance", F.col(_PART)).write.partitionBy(_PART).mode("overwrite").parquet(to)
        return {n.partition("=")[2]: [f"data/v={version}/{n}"] for n in self._names(to) if n.startswith(f"{_PART}=")}

    def replace(self, table: str, version: int, rows: DataFrame, part: Column, touched: Collection[str], gone: Collection[str] = ()) -> None:
        """A version whose ``touched`` parts hold ``rows`` and nothing else, and whose other parts are as before, but for
        those that are ``gone``, whose rows are among ``rows``. ``part`` names a row's part: letters, digits and hyphens."""
        new = self._data(table, version, rows, part)
        if stray := set(new) - set(touched):
            raise ValueError(f"rows of parts that are not replaced: {sorted(stray)[:3]}")
        kept = {p: f for p, f in self.manifest(table, version).items() if p not in touched and p not in gone}
        self._publish(table, version, kept | new)

    def append(self, table: str, version: int, rows: DataFrame, part: Column) -> None:
        """A version with ``rows`` beside those that were there."""
        old, new = self.manifest(table, version), self._data(table, version, rows, part)
        self._publish(table, version, {p: old.get(p, []) + new.get(p, []) for p in old | new})

    def write(self, table: str, version: int, rows: DataFrame) -> None:
        """A version of one part that holds ``rows``, as they are dealt out."""
        folder = f"data/v={version}/{_PART}=all"
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/{folder}")
        self._publish(table, version, {"all": [folder]})

    def put(self, table: str, version: int, rows: DataFrame) -> DataFrame:
        """Write a version and read it."""
        self.write(table, version, rows)
        return self.read(table, rows.schema, version + 1)

    def drop(self, table: str) -> None:
        """Remove a table with all its versions."""
        self._fs.delete(self._path(f"{self.root}/{table}"), True)

    def vacuum(self, table: str, keep: int = 2) -> list[str]:
        """Remove all versions but the latest ``keep``, and the folders of data that none of these names; returns
        the folders that are gone."""
        versions = self.versions(table)
        named = {f for v in versions[-keep:] for folders in self.manifest(table, v + 1).values() for f in folders}
        gone = []
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{table}/manifest/{v}.json"), False)
        for v in [n for n in self._names(f"{self.root}/{table}/data") if not versions or int(n[2:]) <= versions[-1]]:
            for n in [n for n in self._names(f"{self.root}/{table}/data/{v}") if n.startswith(f"{_PART}=")]:
                if (folder := f"data/{v}/{n}") not in named:
                    self._fs.delete(self._path(f"{self.root}/{table}/{folder}"), True)
                    gone.append(folder)
        return gone
