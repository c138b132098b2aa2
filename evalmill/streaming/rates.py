"""Streams of executions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def success_rate(events: DataFrame, width: str = "30 minutes", late: str = "10 minutes", failed: str = "error") -> DataFrame:
    """Events, failures and the success rate of each window; on a stream, late rows count until the watermark."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    out = src.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == failed).cast("long")).alias("n_failed"))
    return out.select(F.col("w.start").alias("window_start"), "n", "n_failed", F.round(1 - F.col("n_failed") / F.col("n"), 6).alias("success_rate"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; rows go to Parquet in append mode."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream, whether it is a file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def newest_windows(windows: DataFrame, path: str, key: str = "window_start") -> DataFrame:
    """The last state of each window of a stream of all that is there.

    Batches write the windows that they changed; the watermark lets the stream
    forget closed ones.  Without any input the result is empty.
    """
    spark = windows.sparkSession

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/em_batch={n}")

    spark.createDataFrame([], windows.schema).write.mode("overwrite").parquet(f"{path}/out/em_batch=-1")
    windows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in windows.columns if c != key]), "em_batch").alias("x")).select(key, "x.*")
