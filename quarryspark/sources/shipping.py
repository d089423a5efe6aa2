"""Gives the executors' Python workers this package, whatever their working folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = held.get() if held.isDefined() else f"{tempfile.gettempdir()}/quarryspark-checkpoints"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for tables that a query reads more than once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Add the package as a file of the application, through the shared folder; once for each application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    path = f"{shared_dir(spark)}/quarryspark-{uuid.uuid4().hex}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(data.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)
