"""Structured Streaming: resumable record ingest and windowed trace summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def records(spark: SparkSession, folder: str, schema, form: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(folder)


def ingest(rows: DataFrame, folder: str, checkpoint: str, key: str = "record_id", time: str = "ts", late: str = "1 hour") -> StreamingQuery:
    """Appends each record once; a restart continues from the checkpoint."""
    once = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def trace_windows(rows: DataFrame, time: str, by: str, value: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and means by window, closed as the watermark passes."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_value")).select(F.col("window.start").alias("start"), by, "n", "mean_value")
