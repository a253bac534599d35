"""Versioned tables: parts by key hash, a manifest a version, only touched parts rewritten.

A table is a folder with `manifests/<version>.json`, which lists the part folders of that version,
and `data/<version>/_part=<n>/`, which hold rows. An upsert reads and rewrites the parts that its
rows fall into; the manifest of the new version takes all others over from the version before, so
both versions share their files. A version exists once its manifest does, and what a write that was
cut off has left is overwritten when it is tried again. Plain Parquet and folders, through Hadoop's
file interface: any store that Spark reads will do.

The driver handles manifests and names of folders only: one entry a part, and the number of parts
is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a new table, unless it says otherwise. A part is what an upsert rewrites at least.
PARTS = 64
#: Versions that stay; ids of a log that stay below its newest.
KEEP, RING = 30, 5000
_PART = "_part"


class Folder:
    """The files below a folder, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self._of(f"{self.path}/{name}")

    def names(self, name: str = "") -> list[str]:
        where = self.at(name) if name else self._of(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written under another name and moved."""
        stream = self._fs.create(self.at(f"{name}.tmp"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(self.at(name), False)
        self._fs.rename(self.at(f"{name}.tmp"), self.at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


class VersionedTable:
    """Rows are dealt to parts by the hash of their key columns, so an upsert touches the parts of its
    keys only. Versions are names; the newest is the last in their order, numbers by value."""

    def __init__(self, spark: SparkSession, path: str, *, keys: list[str], parts: int = PARTS):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        self.files = Folder(spark, path)

    def versions(self) -> list[str]:
        names = [n.removesuffix(".json") for n in self.files.names("manifests") if n.endswith(".json")]
        return sorted(names, key=lambda n: (0, int(n), n) if n.isdigit() else (1, 0, n))

    def manifest(self, version: str) -> dict:
        return json.loads(self.files.read(f"manifests/{version}.json"))

    def _number(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for n, folder in manifest["folders"].items() if parts is None or int(n) in parts]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: str | None = None) -> DataFrame:
        """Rows of a version, the newest by default."""
        return self._read(self.manifest(version or self.versions()[-1]))

    def write(self, rows: DataFrame, version: str) -> None:
        """A version of these rows alone."""
        self._put(rows, version, {})

    def upsert(self, rows: DataFrame, version: str, merge: Callable[[DataFrame, DataFrame], DataFrame], *, before: str | None = None) -> None:
        """A version after `before` (by default the last one before this): merge(old, new) gets the rows
        of the parts that hold keys of `rows`, and rows."""
        earlier = [v for v in self.versions() if v != version]
        if version.isdigit():
            earlier = [v for v in earlier if not v.isdigit() or int(v) < int(version)]
        before = before or (earlier[-1] if earlier else None)
        if before is None:
            self._put(merge(rows.limit(0), rows), version, {})
            return
        old = self.manifest(before)
        touched = [r[0] for r in rows.select(self._number()).distinct().collect()]  # as many as there are parts at most
        self._put(merge(self._read(old, touched), rows), version, {n: f for n, f in old["folders"].items() if int(n) not in touched})

    def _put(self, rows: DataFrame, version: str, kept: dict) -> None:
        folder = f"data/{version}"
        self.files.delete(folder)  # of a write that was cut off
        rows.withColumn(_PART, self._number()).hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        new = {n.split("=")[1]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith(f"{_PART}=")}
        self.files.write(f"manifests/{version}.json", json.dumps({"schema": rows.schema.jsonValue(), "folders": kept | new}))

    def retain(self, keep: int = KEEP, *, always: tuple[str, ...] = ()) -> list[str]:
        """Keep the newest versions and those named, and delete what no version that stays refers to:
        part folders first lose their manifest, so that no reader meets a version without its rows."""
        versions = self.versions()
        stay = [v for v in versions if v in versions[-keep:] or v in always]
        used = {f for v in stay for f in self.manifest(v)["folders"].values()}
        for v in versions:
            if v not in stay:
                self.files.delete(f"manifests/{v}.json")
        for v in self.files.names("data"):
            folders = [f"data/{v}/{n}" for n in self.files.names(f"data/{v}") if n.startswith(f"{_PART}=")]
            if not used & set(folders):
                self.files.delete(f"data/{v}")
            else:
                for folder in folders:
                    if folder not in used:
                        self.files.delete(folder)
        return stay


class RingTable:
    """The newest rows of a log that grows by batches: those with an id of at least the greatest less `keep`.
    Each batch is a folder of its own with its least and greatest id in the manifest; folders wholly
    below the bound are left out unread, and when more than `most` are left they become one. A batch
    that is tried again replaces what it left."""

    def __init__(self, spark: SparkSession, path: str, *, id: str, keep: int = RING, most: int = 8):
        self.spark, self.path, self.id, self.keep, self.most = spark, path.rstrip("/"), id, keep, most
        self.files = Folder(spark, path)

    def _manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json"))

    def _entries(self, n: int) -> dict:
        return json.loads(self.files.read(f"manifests/{n}.json"))

    def _rows(self, entries: list[dict], schema: StructType) -> DataFrame:
        bound = max((e["high"] for e in entries), default=0) - self.keep
        folders = [f"{self.path}/{e['folder']}" for e in entries]
        return self.spark.read.schema(schema).parquet(*folders).filter(F.col(self.id) >= bound) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        last = self._entries(self._manifests()[-1])
        return self._rows(last["folders"], StructType.fromJson(last["schema"]))

    def _put(self, rows: DataFrame, folder: str) -> list[dict]:
        self.files.delete(folder)
        rows.coalesce(1).write.parquet(f"{self.path}/{folder}")  # keep + 1 ids at most
        low, high = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").agg(F.min(self.id), F.max(self.id)).first()
        return [] if high is None else [{"folder": folder, "low": low, "high": high}]

    def append(self, rows: DataFrame, batch: int) -> None:
        """The rows of batch number `batch`. Rows without id are not kept."""
        earlier = [n for n in self._manifests() if n < batch]
        before = self._entries(earlier[-1])["folders"] if earlier else []
        newest = rows.agg(F.max(self.id)).first()[0]
        most = max([e["high"] for e in before] + ([newest] if newest is not None else []), default=0)
        entries = [e for e in before if e["high"] >= most - self.keep]
        entries += self._put(rows.filter(F.col(self.id) >= most - self.keep), f"data/{batch}")
        if len(entries) > self.most:
            entries = self._put(self._rows(entries, rows.schema), f"data/{batch}-all")
        self.files.write(f"manifests/{batch}.json", json.dumps({"schema": rows.schema.jsonValue(), "folders": entries}))
        # The batch before is needed until the next one begins: this one may be tried again.
        for n in earlier[:-1]:
            self.files.delete(f"manifests/{n}.json")
        used = {e["folder"] for e in entries + before}
        for name in self.files.names("data"):
            if f"data/{name}" not in used:
                self.files.delete(f"data/{name}")
