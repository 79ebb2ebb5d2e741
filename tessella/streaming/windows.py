"""Windowed aggregation of an event stream with watermarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum per window and type; the timestamp becomes one with time zone, as watermarks need."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files: of a folder's, or of one file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def run_available(spark: SparkSession, path: str, folder: str, width: str = "1 day", late: str = "1 hour", name: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream all files that are there now through :func:`windowed`; closed windows are appended to a table in ``folder``.

    A window is written once, as soon as the watermark (the latest time seen less ``late``) reaches its end, and its state
    is dropped; rows that come later than that for a closed window are dropped too. Windows still open are not written: a
    later run with the same ``folder`` and ``name`` goes on from the state that is kept there.
    """
    schema = spark.read.parquet(path).schema
    out = f"{folder.rstrip('/')}/windows-{name or uuid.uuid4().hex}"
    found = windowed(file_stream(spark, path, schema, files_per_batch), width, late)
    query = found.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}-state").start(f"{out}/closed")
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/closed")
