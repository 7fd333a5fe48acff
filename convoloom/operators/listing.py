"""The list of sessions: order, index, limit, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions.ordered import with_index
from convoloom.operators.messages import messages


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, created_ms (first arrival), composer_order (first msg_id of a composer message, null for none)."""
    m = messages(spark, sf_dir)
    composer = F.col("stack").isin("composer", "both")
    return m.groupBy("session_id").agg(F.min(F.unix_millis(F.to_timestamp("received_at"))).alias("created_ms"), F.min(F.when(composer, F.col("msg_id"))).alias("composer_order"))


def order() -> list:
    """Newest first; of equal times the composer's discovery order, then ids by code points."""
    return [F.desc("created_ms"), F.asc_nulls_last("composer_order"), F.asc("session_id")]


def index_sessions(cat: DataFrame) -> DataFrame:
    return with_index(cat, order())


def newest(cat: DataFrame, limit: int | None) -> DataFrame:
    """The first sessions of the list; no limit, or one of 0 or less, gives all."""
    ordered = cat.orderBy(*order())
    return ordered.limit(limit) if limit and limit > 0 else ordered


def page(cat: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows of a page, and one row of total, limit, offset, has_more."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be 1 or more, offset 0 or more")
    rows = cat.orderBy(*order()).offset(offset).limit(limit)
    info = cat.agg(F.count("*").alias("total")).select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.col("total") > offset + limit).alias("has_more"))
    return rows, info


def q02_catalog_index(spark, d):
    return index_sessions(catalog(spark, d)).select("session_id", "created_ms", "index")


def q03_list_limit(spark, d):
    return newest(catalog(spark, d), 20).select("session_id", "created_ms")


def q04_page(spark, d):
    rows, info = page(catalog(spark, d), 25, 50)
    # the information is one row
    return rows.select("session_id").crossJoin(F.broadcast(info.select("total", "has_more")))
