"""What the operators of this folder share: text batches, word rules, and tables in the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.session import ship, spread

#: A word everywhere in these contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a Python worker turns into objects at a time, whatever the Arrow batch holds.
SLICE = 128


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a test folder, through Spark alone, so that any store Spark knows will do."""
    return spread(ship(spark).read.parquet(f"{sf_dir}/{table}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="sillage-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and every copy survives lost executors.

    What no operator forgets, since a result still reads it, goes when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = f"{scratch(spark)}/sillage/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_clear, spark, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(nullable(df.schema)).parquet(path)
    kept.stored_at = path  # type: ignore[attr-defined]
    return kept


_folders: set[str] = set()


def _clear(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more; tables that aren't stored are let be."""
    for df in tables:
        if not hasattr(df, "stored_at"):
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)  # type: ignore[attr-defined]
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name beginning with name that df doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"_{name}_{k}").lower() not in taken)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def whole(text: str | Column = "text") -> Column:
    """The whole text, a null one as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[list[list]]:
    """Columns as Python lists, a few rows at a time, so that a worker never holds a whole batch as objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield [c.to_pylist() for c in part.columns]


def words(text: str) -> list[bytes]:
    """Words as UTF-8: bytes.split() splits at precisely the six ASCII white space characters of WORD."""
    return text.encode("utf-8", "surrogatepass").split()
