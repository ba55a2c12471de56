"""The gate funnel over a growing directory of JSON lines; an extension, as nothing here needs streaming state but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_lines(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def counted(rows: DataFrame) -> DataFrame:
    """Running counts of records, passed ones and reasons."""
    empty = F.array().cast("array<string>")
    marks = F.concat(F.array(F.lit("records")), F.when(F.col("passed"), F.array(F.lit("passed"))).otherwise(empty), F.transform(F.coalesce("reject_reasons", empty), lambda r: F.concat(F.lit("reason:"), r)))
    return rows.select(F.explode(marks).alias("metric")).groupBy("metric").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Counts of each event type in windows of event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def start(rows: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
