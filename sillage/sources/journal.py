"""Tables that grow by parts, level after level, with a manifest from which a stopped iteration goes on."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sillage.sources import tables

#: So many parts of a table that later levels read become one.
MERGED = 8


class Journal:
    """Tables of an iteration in a folder that all executors share: a part is written once, and read with all others of its table in one scan.

    commit() writes a manifest, under a name of its own, of what is whole so far; a new Journal of the same folder and settings goes on from the
    last one. What was written after it is not in it, and so not read: a level that was stopped half way is done again. Manifests of other
    settings are let be. Without a folder the tables go with the driver's Python, and there is nothing to go on from.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, settings: object = None) -> None:
        self.spark, self.lasting = spark, folder is not None
        self.folder = (folder or tables.unique(spark, "journal")).rstrip("/")
        self.name = hashlib.md5(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
        self.parts: dict[str, list[str]] = {}
        self.schemas: dict[str, str] = {}
        self.merged: dict[str, int] = {}
        self.state: dict = {}
        self._old: list[str] = []
        last = self._last() if self.lasting else None
        if last:
            self.parts, self.schemas, self.merged, self.state = (last[k] for k in ("parts", "schemas", "merged", "state"))

    def _last(self) -> dict | None:
        store, at = tables._store(self.spark, f"{self.folder}/manifest-{self.name}-*.json")
        found = store.globStatus(at)
        names = sorted(f.getPath().toString() for f in found or ())
        return json.loads(self.spark.read.text(names[-1], wholetext=True).first()[0]) if names else None

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as a new part of a table, read back."""
        path = f"{self.folder}/{tables.unique(self.spark, name).rsplit('/', 1)[1]}"
        rows.write.option("compression", "zstd").parquet(path)
        self.schemas.setdefault(name, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]).json())
        self.parts.setdefault(name, []).append(path)
        return self._read(name, [path])

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as the whole table; what it was goes when the manifest no longer names it."""
        self._old += self.parts.pop(name, [])
        return self.add(name, rows)

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self.schemas[name]))).parquet(*paths)

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """All parts of a table by one scan; without any, an empty table of that schema."""
        return self._read(name, self.parts[name]) if self.parts.get(name) else self.spark.createDataFrame([], schema)

    def tidy(self, *names: str) -> None:
        """The last MERGED parts of a table become one, so that a row is moved once however many levels there are."""
        for name in names:
            done, parts = self.merged.get(name, 0), self.parts.get(name, [])
            if len(parts) - done >= MERGED:
                self._old += parts[done:]
                rows, self.parts[name] = self._read(name, parts[done:]), parts[:done]
                self.add(name, rows)
                self.merged[name] = done + 1

    def commit(self, level: int, **state: object) -> None:
        """All that is written so far is whole, as of this level."""
        self.state = state
        if self.lasting:
            tables.put_json(self.spark, f"{self.folder}/manifest-{self.name}-{level:09d}.json", {"parts": self.parts, "schemas": self.schemas, "merged": self.merged, "state": state})
        for path in self._old:
            tables.remove(self.spark, path)
        self._old = []
