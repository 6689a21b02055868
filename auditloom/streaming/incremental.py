"""Streams: signal upserts batch by batch, and windowed monitoring of events. An extension, beyond the batch audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.signals import upsert


def upsert_stream(spark: SparkSession, incoming: DataFrame, table: str, checkpoint: str, key: str = "dataset_id"):
    """Keeps ``table`` (a path) current with a stream of signal rows; each batch writes a new version beside the old one."""

    def apply(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        versions = _versions(spark, table)
        merged = upsert(spark.read.parquet(f"{table}/v{versions[-1]}"), fresh, key) if versions else fresh
        merged.write.mode("overwrite").parquet(f"{table}/v{number}")

    return incoming.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path)) if fs.exists(path) else []


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and mean values per window and type; also runs on a batch of events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
