"""Incremental ingest and windows over streams (beyond the batch operators): append each new row once, count by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, kind: str = "parquet") -> StreamingQuery:
    """Append rows of new files to a parquet table, each key once, also if a batch is run again; ends when all files are read."""
    stream = spark.readStream.schema(schema).format(kind).load(source)

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            known = batch.sparkSession.read.parquet(target).select(key)
        except Exception as error:  # noqa: BLE001  the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = None
        if known is not None:
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts by event type with a watermark; events carry ts, event_type and value."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, that end after a gap without events."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
