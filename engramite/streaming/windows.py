"""Streaming forms of the aggregates; each gives the batch answer on the same rows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import shared_base


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) by event time; rows later than ``late`` behind the watermark are dropped in
    append mode."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def evidence(edges: DataFrame) -> DataFrame:
    """(source, relationship, destination, weight): edge evidence, accumulated."""
    return edges.groupBy("source", "relationship", "destination").agg(F.sum("weight").alias("weight"))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session, put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(plan: DataFrame, folder: str) -> bool:
    """Runs a streaming plan over what its source holds now and has not been through ``folder`` yet. True if it ran a batch.

    The query writes what changed, batch by batch, as Parquet below the folder, so nothing gathers in the driver; a batch
    that is repeated after a failure overwrites its own rows. Called again with the same folder, it goes on."""
    from .states import PROVIDER

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/part={n}")

    with setting(plan.sparkSession, *PROVIDER):
        query = plan.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return query.lastProgress is not None


def said(plan: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """What :func:`drain` wrote: the rows last said of each of ``keys``."""
    rows = plan.sparkSession.read.schema(StructType([*plan.schema.fields, StructField("_batch", LongType())])).parquet(f"{folder}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(c) for c in plan.columns if c not in keys)), "_batch").alias("v"))
    return last.select(*(c if c in keys else f"v.{c}" for c in plan.columns))


def drained(spark: SparkSession, plan: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`drain` into a new folder, and the rows it last said of each of ``keys``."""
    folder = f"{shared_base(spark).rstrip('/')}/drained-{uuid.uuid4().hex}"
    if not drain(plan, folder):
        return spark.createDataFrame([], plan.schema)
    return said(plan, folder, keys)
