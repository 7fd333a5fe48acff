"""Streams over event tables: an extension, for the source data knows no streams.

Times are event times under a watermark. Sessions are never synchronised by a watermark: that is done by whole-session
replacement (incremental), because rows may land in the middle of a conversation at any time.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.session import scratch, ship


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file stream over a parquet table, one file or a folder of files."""
    ship(spark)
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def run_complete(df: DataFrame, what: str) -> DataFrame:
    """The whole result of an aggregating stream over all that is available."""
    spark, folder = df.sparkSession, scratch(df.sparkSession, what)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    return stream_table(spark, sf_dir, "events").withColumn("at", F.to_timestamp("ts")).withWatermark("at", delay)


def tumbling(df: DataFrame, width: str, *keys: str) -> DataFrame:
    got = df.groupBy(F.window("at", width), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return got.select(F.unix_millis("window.start").alias("start_ms"), *keys, "n", "cents")


def sliding(df: DataFrame, width: str, step: str) -> DataFrame:
    return df.groupBy(F.window("at", width, step)).agg(F.count("*").alias("n")).select(F.unix_millis("window.start").alias("start_ms"), "n")


def sessions(df: DataFrame, gap: str, key: str) -> DataFrame:
    got = df.groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("n"))
    return got.select(key, F.unix_millis("session_window.start").alias("start_ms"), F.unix_millis("session_window.end").alias("end_ms"), "n")


def q73_stream_tumbling(spark, d):
    return run_complete(tumbling(event_stream(spark, d), "6 hours", "event_type"), "tumbling")


def q74_stream_sliding(spark, d):
    return run_complete(sliding(event_stream(spark, d), "12 hours", "6 hours"), "sliding")


def q75_stream_sessions(spark, d):
    return run_complete(sessions(event_stream(spark, d), "6 hours", "user_id"), "sessions")
