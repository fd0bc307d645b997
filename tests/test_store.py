"""An index that is changed in place: what a change writes, and what stays where it fails."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sillage.operators import index
from sillage.sources import tables
from sillage.sources.store import Store


def rows(store):
    return sorted((r["_key"], r["label"]) for r in store.records().collect())


@pytest.fixture
def made(spark, tmp_path):
    ix = index.added(spark.range(2000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"), (F.col("id") % 7).cast("int").alias("label")))
    store = Store(spark, f"file://{tmp_path}/ix")
    with pytest.raises(FileNotFoundError):
        store.records()
    store.create(ix, 64)
    return ix, store, tmp_path / "ix"


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_changes_in_place(spark, made):
    ix, store, folder = made
    want = {f"{k:05d}": k % 7 for k in range(2000)}
    assert rows(store) == sorted(want.items())
    whole = size(folder)
    store.put(ix.where("id in ('00003', '01999')").withColumn("label", F.lit(-1)))
    want |= {"00003": -1, "01999": -1}
    assert rows(store) == sorted(want.items()) and size(folder) - whole < 0.1 * whole
    store.delete(spark.createDataFrame([("00010",), ("unknown",)], "_key string"))
    del want["00010"]
    new = ix.where("id = '00000'").withColumn("_key", F.lit("new"))
    store.put(new, add=False)
    assert rows(store) == sorted(want.items())
    store.put(new)
    want["new"] = 0
    assert rows(store) == sorted(want.items())
    assert store.clear() == 0 or rows(store) == sorted(want.items())
    with pytest.raises(ValueError, match="repeat"):
        store.put(new.union(new))
    store.delete(ix.select("_key"))
    assert rows(store) == [("new", 0)]


def test_a_failed_write_leaves_the_old_index(spark, made, tmp_path):
    ix, store, _ = made
    before = rows(store)
    broken = ix.where("id = '00003'").withColumn("label", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.put(broken)
    assert rows(store) == before
    path = f"file://{tmp_path}/saved"
    tables.save_index(ix, path)
    with pytest.raises(Exception, match="lost"):
        tables.save_index(broken, path)
    assert tables.load_index(spark, path).count() == 2000
    tables.save_index(ix.where("label = 1"), path)
    assert tables.load_index(spark, path).where("label <> 1").isEmpty()
