"""Transcript files of JSON lines, with the place of each line in its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "file string, line_no int, raw string"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and raw of every line of the *.jsonl files below path; the byte order mark and carriage returns are cut. A file is read in one piece, because places count from its start."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("value", "^\\ufeff", ""), "\n")).alias("i", "raw"))
    kept = lines.select("file", (F.col("i") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("raw"))
    return kept.where("raw <> ''")


def read_meta_files(spark: SparkSession, path: str) -> DataFrame:
    """file, raw of every meta.json below path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
