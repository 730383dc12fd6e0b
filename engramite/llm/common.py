"""Helpers shared by the training-data operators: shared folders, lineage cuts, Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local
    mode; on a cluster, where executors could not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="engramite-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below :func:`shared_base`."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_dir` that is not read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session, put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; the shuffle files it took go as soon as it is written."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: lineage ends, a lost executor loses nothing."""
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read again, and its folder, which the caller drops once nothing reads it. As
    :func:`cut`, but the shuffle files are gone: for steps that are many or large."""
    path = shared_dir(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Rows of an Arrow batch. JVM and Python each hold a batch whole, and Spark's 10,000 whole texts are tens of MB a task.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows for the texts to come; a lower setting stays. Rows are the same."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def text_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so clashing extra columns never meet them."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


#: Upper bits of a hashed id by which rows are counted before a sample is ranked.
SLICE_BITS = 14


def least_hashed(rows: DataFrame, label: str, most: int) -> DataFrame:
    """Of ``rows(doc_id, label)``, of each label the ``most`` whose hashed id is least.

    Counts by the hash's upper bits, combined in the tasks, tell below which bucket the wanted rows lie; only those are
    ranked, so no task sees all rows of a label.
    """
    hashed = rows.withColumn("_h", F.xxhash64("doc_id")).withColumn("_slice", F.shiftright("_h", 64 - SLICE_BITS).cast("int"))
    below = F.sum("n").over(Window.partitionBy(label).orderBy("_slice")) - F.col("n")  # 2 ** SLICE_BITS rows a label at most
    counts = hashed.groupBy(label, "_slice").agg(F.count("*").alias("n")).withColumn("below", below)
    last = counts.where(F.col("below") < most).groupBy(F.col(label).alias("_label")).agg(F.max("_slice").alias("_last"))  # a row a label
    near = hashed.join(last, (F.col(label) == F.col("_label")) & (F.col("_slice") <= F.col("_last")))
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy("_h", "doc_id")))
    return ranked.where(F.col("_k") <= most).select("doc_id", label)


def text_key():
    """Second half of a row's key next to its id: rows that repeat an id with another text stay apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sliced(run, rows: int = 256):
    """``run`` over batches of at most ``rows`` rows: what Python holds at once doesn't follow the session's batch size."""

    def over(batches):
        yield from run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return over


def by_bytes(run, column: int, most: int = 2 << 20):
    """``run`` over slices of batches that hold at most ``most`` bytes in ``column``, or one row."""

    def parts(b: pa.RecordBatch):
        ends, start = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(start, stop - start)
            start = stop

    def over(batches):
        yield from run(part for b in batches for part in parts(b))

    return over
