"""Sessions, and this package on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each Spark context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_sillage_shipped", None) is None:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="sillage-")) / "sillage.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, Path(package.name) / f.relative_to(package))
        context.addPyFile(str(archive))
        context._sillage_shipped = str(archive)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are cores, as small tables of one file do; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def local(cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and measurements."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
