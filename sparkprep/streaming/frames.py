"""Structured Streaming: what can be kept incrementally, and what runs per micro-batch.

Counts by class and by sketch bucket are associative, so they are streaming aggregates with a watermark.
Exact ranks, sorting and keep-last duplicates need all rows; they run on each micro-batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkprep.profile.sketches import gamma


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, time: str, by: Sequence[str], width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped by Spark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counts = stream.withWatermark(time, late).groupBy(window.alias("window"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def windowed_ddsketch(stream: DataFrame, time: str, value: str, width: str = "1 day", late: str = "1 hour", alpha: float = 0.01) -> DataFrame:
    """A DDSketch per window: (start, column, sign, bucket, n, min, max, alpha)."""
    v = F.col(value).cast("double")
    bucket = F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.ln(F.abs(F.when(v != 0, v))) / F.lit(math.log(gamma(alpha))))).cast("int")
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), F.signum(v).cast("int").alias("sign"), bucket.alias("bucket"))
    return rows.agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max")).select(F.col("window.start").alias("start"), F.lit(value).alias("column"), "sign", "bucket", "n", "min", "max", F.lit(alpha).alias("alpha"))


def first_seen(stream: DataFrame, time: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Streaming duplicates within the watermark: the first row of each key passes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a batch transform on every micro-batch and write Parquet, one folder per batch, so a retried batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
