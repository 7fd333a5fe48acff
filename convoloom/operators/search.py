"""Literal search: every match, snippets around the first, sessions ranked by matches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions import text
from convoloom.operators.listing import catalog, index_sessions
from convoloom.operators.messages import messages

QUERY, AROUND = "the error", 50


def matches(m: DataFrame, query: str) -> DataFrame:
    """Rows of m whose content holds the query, case aside, with positions; an empty query matches nothing."""
    return m.where(F.contains(F.lower("content"), F.lit(query.lower())) & F.lit(bool(query))).withColumn("positions", text.match_positions(F.col("content"), query))


def fold_spans(content: str, query: str) -> list[tuple[int, int]]:
    """Half-open UTF-16 spans of all matches in the original text, where lower case may change widths: every unit of the folded text knows the original character it came from."""
    wanted = query.lower().encode("utf-16-le")
    if not wanted:
        return []
    folded, starts, ends, at = [], [], [], 0
    for ch in content:
        unit = ch.lower().encode("utf-16-le")
        width = len(ch.encode("utf-16-le")) // 2
        folded.append(unit)
        starts += [at] * (len(unit) // 2)
        ends += [at + width] * (len(unit) // 2)
        at += width
    whole, out, i = b"".join(folded), [], 0
    while (i := whole.find(wanted, i)) >= 0:
        if i % 2 == 0:
            span = (starts[i // 2], ends[(i + len(wanted)) // 2 - 1])
            if not out or out[-1] != span:
                out.append(span)
        i += 1
    return out


def utf16_spans(m: DataFrame, key: str, content: str, query: str) -> DataFrame:
    """key, start, end of every match as UTF-16 offsets into the original text, exact for any letters."""

    def go(batches):
        for b in batches:
            rows = [(k, *s) for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if c for s in fold_spans(c, query)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=[key, "start", "end"])

    return m.select(key, content).mapInArrow(go, f"{key} {dict(m.dtypes)[key]}, start int, end int")


def snippets(found: DataFrame, query: str, around: int = AROUND) -> DataFrame:
    """session_id, msg_id, role, text, positions (inside the snippet), n_matches (all)."""
    s = text.snippet_of(F.col("content"), F.col("positions"), len(query), around)
    return found.select("session_id", "msg_id", "role", F.size("positions").alias("n_matches"), s.alias("s")).select("session_id", "msg_id", "role", "n_matches", "s.text", "s.positions")


def rank_sessions(snips: DataFrame, cat: DataFrame, limit: int | None) -> DataFrame:
    """Sessions by matches inside their snippets, most first, equals in the order of the list; no limit or 0 gives all."""
    counts = snips.groupBy("session_id").agg(F.sum(F.size("positions")).alias("match_count"), F.count("*").alias("n_snippets"))
    ranked = counts.join(cat, "session_id").orderBy(F.desc("match_count"), F.desc("created_ms"), F.asc_nulls_last("composer_order"), F.asc("session_id"))
    return (ranked.limit(limit) if limit else ranked).select("session_id", "match_count", "n_snippets", "created_ms")


def q10_search_positions(spark, d):
    found = matches(messages(spark, d), QUERY)
    return found.select("msg_id", F.posexplode("positions").alias("match_no", "position"))


def q11_search_snippets(spark, d):
    got = snippets(matches(messages(spark, d), QUERY), QUERY)
    return got.select("msg_id", "role", "n_matches", "text", F.size("positions").alias("n_inside"), F.get("positions", F.lit(0)).alias("first_inside"))


def q12_search_topk(spark, d):
    return rank_sessions(snippets(matches(messages(spark, d), QUERY), QUERY), catalog(spark, d), 10)


def q13_search_line_context(spark, d):
    found = matches(messages(spark, d), QUERY).withColumn("c", text.line_context(F.col("content"), F.get("positions", F.lit(0)), 1))
    return found.select("msg_id", F.col("c.line_no").alias("line_no"), F.col("c.line").alias("line"), F.array_join("c.before", "\n").alias("before"), F.array_join("c.after", "\n").alias("after"))


def q65_search_utf16(spark, d):
    return utf16_spans(messages(spark, d).where(F.contains(F.lower("content"), F.lit(QUERY))), "msg_id", "content", QUERY)


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its index, for results that show it."""
    return index_sessions(catalog(spark, sf_dir)).select("session_id", "index")
