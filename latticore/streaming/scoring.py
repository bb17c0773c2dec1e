"""Scoring on streams: the same projections as on tables, and class counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticore.operators.mixture import Fit


def score_stream(fit: Fit, stream: DataFrame) -> DataFrame:
    """The stream with posterior, class, probability and loglik: stateless, no Python worker."""
    return fit.transform(stream)


def windowed_classes(fit: Fit, stream: DataFrame, time: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows and posterior mass of each class in tumbling windows; state is dropped once the watermark has passed."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    scored = fit.transform(stream.withWatermark(time, late)).where(F.col("class").isNotNull())
    k = fit.spec.k
    return scored.groupBy(F.window(time, window), "class").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("posterior")[c]).alias(f"mass_{c + 1}") for c in range(k)))


def windowed_patterns(stream: DataFrame, items: list[str], time: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Response patterns of each window, as they would feed a refit."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *(F.col(f"`{c}`") for c in items)).agg(F.sum(F.lit(1.0)).alias("w"))


def read_stream(spark, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream, whether it is a folder of files or one file."""
    path = f"{folder.rstrip('/')}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, name: str = "stream") -> DataFrame:
    """All that is available now run through the stream into the shared folder, and read back."""
    import uuid

    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:  # a local folder only where the executors are this very process
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file:///tmp/checkpoints/latticore"
    at = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
