"""Items of varying length in containers of fixed capacity, by bulk-synchronous best fit.

Items of equal size are interchangeable, and so are containers with equal gaps; the plan therefore works on runs: all
items of a size, all containers of a gap. Sizes go in falling order, one superstep each: a sweep over the sorted gaps
finds the successor of the size (the smallest gap that holds it), ranks decide which items of the run get the
containers of which gap run, gaps are updated, and the rest goes to the next gap or opens new containers. That is
exact best-fit decreasing, and its state is bounded by the capacity (sizes and gaps are at most that), not by the
number of items: the driver sees one count per size. Ranks within a size are counted in chunks, so a size that holds a
third of all items is spread like any other, and each item finds its place by its (size, rank) in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoloom.llm.tokenise import TOKENIZERS, count_tokens
from convoloom.session import settle, table

OUT = "window_id bigint, doc_id bigint, piece_no int, window_no bigint, start_pos bigint, n_tokens bigint"


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, container, offset, copies): items of the size from that rank on go, copies to a container, into containers from that one on at offsets from that one on.

    counts: items by size, sizes from 1 to capacity.
    """
    plan, gaps, runs, opened = [], [], {}, 0

    def put(gap, start, n):
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((start, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            i = bisect_left(gaps, size)
            if i < len(gaps):
                gap = gaps[i]
                start, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[i]
            else:
                gap, start, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            copies = gap // size
            taken = min(left, n * copies)
            plan.append((size, rank, start, capacity - gap, copies))
            full, rest = divmod(taken, copies)
            put(gap - copies * size, start, full)
            if rest:
                put(gap - rest * size, start + full, 1)
            put(gap, start + full + bool(rest), n - full - bool(rest))
            rank, left = rank + taken, left - taken
    return np.array(plan, np.int64).reshape(-1, 5)


def places(plan: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Container and offset of items by size and rank, in integers at any capacity and any number of items."""
    # a plan lists the rows of a size together, by rank: so first the size's rows, then the rank among them
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    p = plan[order]
    no, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    by_size = np.argsort(size, kind="stable")
    sizes, starts = np.unique(size[by_size], return_index=True)
    first, behind = np.searchsorted(p[:, 0], sizes), np.searchsorted(p[:, 0], sizes, side="right")
    for mine, f, t in zip(np.split(by_size, starts[1:]), first, behind):
        row = p[f + np.searchsorted(p[f:t, 1], rank[mine], side="right") - 1]
        k = rank[mine] - row[:, 1]
        no[mine], at[mine] = row[:, 2] + k // row[:, 4], row[:, 3] + k % row[:, 4] * row[:, 0]
    return no, at


def pack(items: DataFrame, windows: dict[int, int], chunks: int | None = None) -> DataFrame:
    """OUT for items (doc_id, n_tokens) and windows {window_id: capacity}: every item in containers of every capacity.

    An item above the capacity is cut into pieces of the capacity and a rest, piece_no from 0; no other is. Items of no
    tokens, or null, need no room: window_no is null, piece_no and start_pos 0. Ties of size go by a hash of doc_id,
    then doc_id; equal doc_ids are items of their own in no fixed order. An empty table gives no rows.
    """
    spark = items.sparkSession
    chunks = chunks or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    windows = {int(w): int(c) for w, c in windows.items() if c is not None and c > 0}
    got = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"))
    each = F.array(*[F.struct(F.lit(w).cast("bigint").alias("window_id"), F.lit(c).cast("bigint").alias("capacity")) for w, c in windows.items()])
    got = got.select("doc_id", "n", F.inline(each))
    last = F.greatest(F.lit(0), F.call_function("div", F.col("n") - 1, F.col("capacity"))).cast("int")
    got = got.select("window_id", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    got = got.select("window_id", "doc_id", "piece_no", F.least("capacity", F.col("n") - F.col("piece_no") * F.col("capacity")).alias("size"), F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(chunks)).cast("int").alias("chunk"))
    # at most capacity x chunks rows: the only thing that is gathered
    per_chunk = settle(got.where("size > 0").groupBy("window_id", "size", "chunk").count(), "sizes")
    totals = {w: {} for w in windows}
    for r in per_chunk.groupBy("window_id", "size").agg(F.sum("count").alias("n")).toLocalIterator():
        totals[r["window_id"]][r["size"]] = r["n"]
    shared = spark.sparkContext.broadcast({w: best_fit_plan(c, windows[w]) for w, c in totals.items()})
    before = F.coalesce(F.sum("count").over(Window.partitionBy("window_id", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_chunk.select("window_id", "size", "chunk", before.alias("before"))
    w = Window.partitionBy("window_id", "size", "chunk").orderBy("doc_id", "piece_no")
    ranked = got.where("size > 0").withColumn("r", F.row_number().over(w)).join(starts, ["window_id", "size", "chunk"]).select("window_id", "doc_id", "piece_no", "size", (F.col("before") + F.col("r") - 1).alias("rank"))

    def go(batches):
        for b in batches:
            window, size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            no, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k in np.unique(window):
                mine = window == k
                no[mine], at[mine] = places(shared.value[int(k)], size[mine], rank[mine])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(no), pa.array(at), b.column(3)], names=[c.split()[0] for c in OUT.split(", ")])

    none = got.where("size <= 0").select("window_id", "doc_id", "piece_no", F.lit(None).cast("bigint").alias("window_no"), F.lit(0).cast("bigint").alias("start_pos"), F.lit(0).cast("bigint").alias("n_tokens"))
    return ranked.mapInArrow(go, OUT).unionByName(none)


def document_sizes(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    return settle(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", folder=folder), "tokens")


def capacities(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    """context_windows has 3 rows at any scale (TESTDATA.md)."""
    return {r["window_id"]: r["token_limit"] for r in table(spark, sf_dir, "context_windows").collect()}


def p9_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(document_sizes(spark, sf_dir), capacities(spark, sf_dir))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each context window: containers used, tokens in them, and the share of their room that is filled."""
    limits = table(spark, sf_dir, "context_windows").select("window_id", "token_limit")
    used = p9_windows(spark, sf_dir).where("window_no is not null").groupBy("window_id").agg((F.max("window_no") + 1).alias("n_windows"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(F.broadcast(limits), "window_id").select("window_id", "n_windows", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_windows") * F.col("token_limit")), 6).alias("fill"))
