"""Shared helpers of the training-data operators: tables, shared folders, ranks and text batches."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one vectorised step works on at most (a single longer text is a step of its own).
STEP_CHARS = 1_000_000
#: Rows and bytes of an Arrow batch, where the session has Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Row groups of intermediate tables: what a writer and a reader hold at once.
ROW_GROUP_BYTES = 32 << 20
#: A key is hot if it holds this share of all rows; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store it knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, through the shared folder; once for each application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:  # Spark's default; rows are whole documents here
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64MB"):  # as above
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    package, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    jvm, path = spark._jvm, f"{fresh_path(spark, 'package')}.zip"
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(data.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = held.get() if held.isDefined() else f"{tempfile.gettempdir()}/quarryspark-checkpoints"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder name under the shared folder; the driver deletes it when it ends, unless it is to be kept."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.deleteOnExit(target)  # this FileSystem is cached, so it is the one closed at the end
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions that a shuffle of whole texts is dealt over."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_batches(batches: Iterator[pa.RecordBatch], text: str = "text", step: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches that hold about step bytes of text, with their texts (null as empty); a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            before = int(ends[begin] - sizes[begin])
            end = max(begin + 1, int(np.searchsorted(ends, before + step, "right")))
            part = batch.slice(begin, end - begin)
            yield part, [t if t is not None else "" for t in part.column(text).to_pylist()]
            begin = end


def join_spread(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """left join-ed (inner) with right, which has each key once and says in count how often left has it, total rows in all.

    Keys of HOT_SHARE of all rows or more, at most 1 / HOT_SHARE of them, reach left by broadcast, so that a key that holds a
    third of all rows stays dealt over all tasks; the others meet in a shuffle. The result has left's columns, then right's.
    """
    names, bound = [c for c in right.columns if c not in (key, count)], max(2.0, total * HOT_SHARE)
    hot = right.filter(F.col(count) >= bound).select(key, F.struct(*names).alias("_hot"))
    cold = right.filter(F.col(count) < bound).select(key, *names)
    marked = left.join(F.broadcast(hot), key, "left")
    found = marked.filter("_hot IS NOT NULL").select(*left.columns, *(F.col("_hot")[c].alias(c) for c in names))
    return found.unionByName(marked.filter("_hot IS NULL").select(*left.columns).join(cold, key).select(*left.columns, *names))


def shield(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones under private names, and the way back to docs' own columns.

    An operator can so add columns of any name without a clash with a caller's.
    """
    names = {c: c if c in used else f"_own_{i}" for i, c in enumerate(docs.columns)}

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(names[c]).alias(c) for c in docs.columns))

    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), restore


def bucketed(df: DataFrame, *keys: str, buckets: int) -> DataFrame:
    """df with a column _bucket that spreads the keys evenly."""
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
