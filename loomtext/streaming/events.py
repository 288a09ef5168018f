"""Event windows and breaker states, over tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate(events: DataFrame, seconds: int = 60, limit: int = 30, late: str | None = None) -> DataFrame:
    """Calls in each fixed window, and whether they pass the limit. On a stream, `late` is the watermark's delay."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    w = F.window("ts", f"{seconds} seconds")
    return x.groupBy(w).agg(F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("window_start"), "calls", (F.col("calls") > limit).alias("over_limit"))


def breaker(outcomes: DataFrame, failures: int = 3) -> DataFrame:
    """Runs of failures of each service that open its breaker: service, first and last time, length. outcomes: service, seq, ts, ok."""
    w = Window.partitionBy("service").orderBy("ts", "seq")
    island = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = outcomes.withColumn("run", island).where(~F.col("ok")).groupBy("service", "run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= failures).drop("run")


def stream_blocks(spark, folder: str, schema) -> DataFrame:
    """Blocks from new files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def distinct_texts(blocks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of texts to translate, each once within the watermark."""
    return blocks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source_text"])


def write_log(stream: DataFrame, path: str, checkpoint: str):
    """Append events as JSON lines."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
