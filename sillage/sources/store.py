"""An index in storage that is changed in place: records in buckets by key, of which a change writes the touched ones alone, and a pointer moved last."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.sources.tables import _store, exists, put_json

#: Buckets of an index. A change of a few keys writes about as many of them.
BUCKETS = 256


def _bucket(n: int):  # noqa: ANN202
    return F.pmod(F.xxhash64(F.coalesce(F.col("_key").cast("string"), F.lit(""))), F.lit(n)).cast("int")


@dataclass
class Store:
    """Records (with _key, as index.added() makes them) under path.

    pointer.json names the generation of every bucket. A change reads the buckets of its keys, writes them as a generation of their own, and then
    moves the pointer: readers see the old index or the new one, and a change that fails on the way leaves the old one as it was. One
    writer at a time; old generations stay until clear().
    """

    spark: SparkSession
    path: str

    def pointer(self) -> dict:
        if not exists(self.spark, f"{self.path}/pointer.json"):
            raise FileNotFoundError(f"no index at {self.path}")
        store, there = _store(self.spark, f"{self.path}/pointer.json")
        held = store.open(there)
        try:
            return json.loads(bytes(held.readAllBytes()).decode())
        finally:
            held.close()

    def create(self, records: DataFrame, buckets: int = BUCKETS) -> None:
        """records as the whole index, in place of any other."""
        self._write(records, {"buckets": buckets, "schema": records.schema.json(), "of": {}}, None)

    def records(self, only: list[int] | None = None) -> DataFrame:
        """All records, or those of some buckets."""
        from pyspark.sql.types import StructType

        at = self.pointer()
        schema = StructType.fromJson(json.loads(at["schema"]))
        paths = [f"{self.path}/{generation}/_bucket={b}" for b, generation in at["of"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, at: dict, touched: list[int] | None) -> None:
        generation = f"generation-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", _bucket(at["buckets"])).repartition("_bucket")
        dealt.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{generation}")
        store, there = _store(self.spark, f"{self.path}/{generation}")
        made = [s.getPath().getName().split("=")[1] for s in store.listStatus(there) if s.getPath().getName().startswith("_bucket=")]
        kept = {b: g for b, g in at["of"].items() if touched is not None and int(b) not in touched}
        put_json(self.spark, f"{self.path}/pointer.json", at | {"of": kept | {b: generation for b in made}})

    def _touched(self, keys: DataFrame, buckets: int) -> list[int]:
        return [r["b"] for r in keys.select(_bucket(buckets).alias("b")).distinct().collect()]

    def _change(self, keys: DataFrame, change) -> None:  # noqa: ANN001
        at = self.pointer()
        touched = self._touched(keys, at["buckets"])
        if touched:
            self._write(change(self.records(touched)), at, touched)

    def delete(self, keys: DataFrame) -> None:
        """Without the keys of a table (_key); unknown ones change nothing but write their bucket anew."""
        gone = keys.select("_key").distinct()
        self._change(gone, lambda old: old.join(gone, "_key", "left_anti").select(*old.columns))

    def put(self, changes: DataFrame, add: bool = True) -> None:
        """The records of changes in place of those of the same key; keys that the index lacks are added, or left out without add. Changes have
        one record for a key."""
        if not changes.groupBy("_key").count().where("count > 1").isEmpty():
            raise ValueError("changes repeat a key")

        def change(old: DataFrame) -> DataFrame:
            new = changes if add else changes.join(old.select("_key").distinct(), "_key", "left_semi")
            return old.join(changes.select("_key"), "_key", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))

        self._change(changes, change)

    def clear(self) -> int:
        """Delete generations that the pointer doesn't name any more; how many went. Not while anyone reads an older pointer's records."""
        live, gone = set(self.pointer()["of"].values()), 0
        store, there = _store(self.spark, self.path)
        for s in store.listStatus(there):
            if s.getPath().getName().startswith("generation-") and s.getPath().getName() not in live:
                gone += bool(store.delete(s.getPath(), True))
        return gone
