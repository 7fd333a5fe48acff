"""Queries of problem 3 over the archive tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.operators.timestamps import normalise_times
from convoloom.functions.times import CONVENTION, utc_ms
from convoloom.session import table

FIELDS = [("store_meta", "meta_id", "created_at_ms"), ("store_meta", "meta_id", "updated_at_ms"), ("sessions", "session_row_id", "created_at"), ("messages", "msg_id", "msg_time")]


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workspace_id and zone: workspaces has 240 rows at any scale (TESTDATA.md), so it may be broadcast."""
    return F.broadcast(table(spark, sf_dir, "workspaces").select("workspace_id", "tz"))


def all_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name in ("store_meta", "sessions", "messages"):
        key, fields = next(k for n, k, _ in FIELDS if n == name), [f for n, _, f in FIELDS if n == name]
        values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
        parts.append(table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), "workspace_id", "received_at", F.inline(values)))
    return reduce(DataFrame.unionByName, parts).join(zones(spark, sf_dir), "workspace_id", "left").withColumn("source", F.concat_ws(".", "tbl", "field"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated order of day and month leaves each text one reading at most, so it is read in one pass without a mixture."""
    got = all_times(spark, sf_dir).withColumn("utc_ms", utc_ms(F.col("value"), F.col("tz")))
    return got.where("utc_ms is not null").select("tbl", "row_id", "field", "utc_ms")


def p3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values without a given order of day and month: the mixture decides, and says where it can't."""
    forms = (*CONVENTION, "slash_dmy", "dot_mdy")
    return normalise_times(all_times(spark, sf_dir), "value", "tz", "source", "received_at", forms).select("tbl", "row_id", "field", "utc_ms", "form", F.round("posterior", 6).alias("posterior"), "status")
