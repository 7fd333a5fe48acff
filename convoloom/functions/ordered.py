"""Neighbours in one order over a whole table, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoloom.session import settle


def with_next(df: DataFrame, order: list[str], columns: list[str], what: str = "ordered") -> DataFrame:
    """df with the struct next: columns of the row that follows in the given order; null behind the last.

    One range sort over all order columns makes pieces of like size, however rows share values; inside a piece the next
    row is a window away, and each piece's last row takes the first row of the next piece that has one. order must
    fix one order. The sorted table is written to the shared folder.
    """
    sorted_ = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__piece"), F.monotonically_increasing_id().alias("__g")), what)
    row = F.struct(*columns)
    firsts = sorted_.groupBy("__piece").agg(F.min_by(row, "__g").alias("__first"))
    # one row for each piece: as many as the session has shuffle partitions
    heads = firsts.select((F.coalesce(F.lag("__piece").over(Window.orderBy("__piece")), F.lit(-1))).alias("__piece"), "__first")
    got = sorted_.withColumn("__in", F.lead(row).over(Window.partitionBy("__piece").orderBy("__g")))
    return got.join(F.broadcast(heads), "__piece", "left").withColumn("next", F.coalesce("__in", "__first")).drop("__piece", "__g", "__in", "__first")


def with_index(df: DataFrame, order: list, name: str = "index", what: str = "indexed") -> DataFrame:
    """df with its 1-based place in a total order given by columns, without one task that sees all rows.

    A range sort makes pieces of like size; a row's place is its place in the piece behind the counts of the pieces
    before it. order must fix one order. The sorted table is written to the shared folder.
    """
    piece = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = settle(piece.select("*", F.spark_partition_id().alias("__piece"), F.monotonically_increasing_id().alias("__g")), what)
    # one row for each piece: as many as the session has shuffle partitions
    pieces = sorted_.groupBy("__piece").agg(F.count("*").alias("__n"), F.min("__g").alias("__first"))
    w = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("__piece", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    got = sorted_.join(F.broadcast(starts), "__piece")
    return got.withColumn(name, F.col("__before") + F.col("__g") - F.col("__first") + 1).drop("__piece", "__g", "__first", "__before")


def pieces_of(df: DataFrame, order: list, what: str) -> DataFrame:
    """df in one global order, with __piece and __g: the range a row fell into and its place in the order."""
    return settle(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__piece"), F.monotonically_increasing_id().alias("__g")), what)


def nearest_values(df: DataFrame, key: str, order: list[str], value: str, previous: str = "previous", following: str = "following", what: str = "nearest") -> DataFrame:
    """df with the nearest non-null value before and after each row of the same key, in an order that key leads.

    Both looks are running aggregates inside a piece (never a frame that starts anew at each row); what lies beyond a
    piece comes from one summary row for each key and piece. A key of any size is spread over pieces. Null keys count
    as one key.
    """
    got = pieces_of(df, [key, *order], what)
    run = lambda *by: Window.partitionBy("__piece", key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumns({"__p": F.last(value, ignorenulls=True).over(run("__g")), "__f": F.last(value, ignorenulls=True).over(run(F.desc("__g")))})
    ends = got.groupBy(key, "__piece").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__g"))).alias("__last"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col("__g"))).alias("__first"))
    over = lambda *by: Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("__k"), F.col("__piece").alias("__q"), F.last("__last", ignorenulls=True).over(over("__piece")).alias("__bp"), F.last("__first", ignorenulls=True).over(over(F.desc("__piece"))).alias("__bf")).where("__bp is not null or __bf is not null")
    got = got.join(ends, (F.col(key).eqNullSafe(F.col("__k"))) & (F.col("__piece") == F.col("__q")), "left")
    return got.withColumns({previous: F.coalesce("__p", "__bp"), following: F.coalesce("__f", "__bf")}).drop("__piece", "__g", "__p", "__f", "__k", "__q", "__bp", "__bf")


def place_in_key(df: DataFrame, key: str, order: list[str], name: str = "place", what: str = "places") -> DataFrame:
    """df with the 1-based place of each row among those of its key, a key of any size spread over pieces."""
    got = pieces_of(df, [key, *order], what)
    # rows of a key are neighbours, so a place is a difference of places in the whole order, corrected by what earlier pieces hold
    counts = got.groupBy(key, "__piece").agg(F.count("*").alias("__n"), F.min("__g").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(key).alias("__k"), F.col("__piece").alias("__q"), "__first", before.alias("__before"))
    got = got.join(counts, (F.col(key).eqNullSafe(F.col("__k"))) & (F.col("__piece") == F.col("__q")))
    return got.withColumn(name, F.col("__before") + F.col("__g") - F.col("__first") + 1).drop("__piece", "__g", "__k", "__q", "__first", "__before")


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "total", what: str = "running") -> DataFrame:
    """df with the sum of value up to and with each row in a global order: sums inside pieces behind the sums of the pieces before."""
    got = pieces_of(df, order, what)
    sums = got.groupBy("__piece").agg(F.sum(value).alias("__s"))
    # one row for each piece: as many as the session has shuffle partitions
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = got.join(F.broadcast(sums.select("__piece", before.alias("__before"))), "__piece")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__piece").orderBy("__g").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return got.withColumn(name, inside + F.col("__before")).drop("__piece", "__g", "__before")
