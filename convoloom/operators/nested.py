"""Nested semi-structured records as flat tables that keep parent and place.

Each level of arrays becomes a child table: the elements of one level are exploded with their ordinal and the path of
their parent, and only elements that hold content again go on to the next level. The merged schema of what goes on,
one map-side combined aggregate, says whether there is a next level, so any depth is reached and no depth is assumed.
Each level is written to the shared folder once, with the columns wanted of it, as a cut of lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions.times import bound
from convoloom.session import settle, table

LIST = "array<variant>"


def whole_json(raw: Column) -> Column:
    """The VARIANT of a text that holds exactly one JSON value, else null. Inside brackets a tail behind the value fails the parse, and a second value makes two elements. A text is parsed once."""
    parsed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.regexp_replace(raw, "^\\ufeff", ""), F.lit("]"))), "$", LIST)
    return bound(parsed, lambda one: F.when(F.size(one) == 1, F.get(one, F.lit(0))))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID or another scalar."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


OBJECT_TEXT, STRING_TEXT = "^\\ufeff?[ \\t\\r\\n]*\\{", "^\\ufeff?[ \\t\\r\\n]*\""


def record(raw: Column) -> Column:
    """The object that a line holds, also if it is wrapped in a JSON string; else null. The first sign of a text tells which it can be, so no text is parsed to no end."""
    inner = bound(F.try_variant_get(whole_json(raw), "$", "string"), lambda s: F.when(s.rlike(OBJECT_TEXT), whole_json(s)))
    return F.when(raw.rlike(OBJECT_TEXT), whole_json(raw)).when(raw.rlike(STRING_TEXT), inner)


def elements(content: Column) -> Column:
    """Content as a list of parts: a plain string is one part of type text, null or anything else has none."""
    text = lambda c: F.array(F.parse_json(F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.try_variant_get(c, "$", "string")))))
    return bound(content, lambda c: F.coalesce(F.try_variant_get(c, "$", LIST), F.when(kind(c) == "STRING", text(c))))


def merged_schema(df: DataFrame, column: str) -> str:
    """The merged schema of all values of a VARIANT column; VOID for none."""
    return df.agg(F.schema_of_variant_agg(column).alias("s")).first()["s"] or "VOID"


def unnest(df: DataFrame, key: str, content: Column, descend: Column, columns: dict[str, Column] | None = None) -> DataFrame:
    """One row for each part at any depth: key, parent_path, ordinal, part_path, level and columns.

    content gives the VARIANT of a row's content; descend, over the column part (a VARIANT), the content of a part that
    holds parts, or null; columns, over part too, what is wanted of each part (by default part itself). Paths are
    ordinals from 0 joined by dots; top parts have the parent path ''. Rows with null or empty content have no parts,
    null elements are parts, equal rows give equal parts each, and an empty table none. Each level is computed once and
    written; what goes on to the next is read from there.
    """
    columns = columns or {"part": F.col("part")}
    path = F.when(F.col("parent_path") == "", F.col("ordinal").cast("string")).otherwise(F.concat_ws(".", "parent_path", "ordinal"))
    at, levels = df.select(key, F.lit("").alias("parent_path"), content.alias("content")), []
    while True:
        got = at.select(key, "parent_path", F.posexplode(elements(F.col("content"))).alias("ordinal", "part"))
        below = bound(descend, lambda c: F.when(~F.is_variant_null(c), c))
        got = got.select(key, "parent_path", "ordinal", path.alias("part_path"), F.lit(len(levels)).alias("level"), *[c.alias(n) for n, c in columns.items()], below.alias("__below"))
        got = settle(got, f"unnest{len(levels)}")
        levels.append(got.drop("__below"))
        at = got.where("__below is not null").select(key, F.col("part_path").alias("parent_path"), F.col("__below").alias("content"))
        if merged_schema(at, "content") == "VOID":
            return reduce(DataFrame.unionByName, levels)


def tool_result_content() -> Column:
    return F.when(F.try_variant_get("part", "$.type", "string") == "tool_result", F.try_variant_get("part", "$.content", "variant"))


def transcript_parts(spark: SparkSession, sf_dir: str, columns: dict[str, Column] | None = None) -> DataFrame:
    lines = table(spark, sf_dir, "transcript_lines").select("line_id", F.try_variant_get(record(F.col("raw")), "$.message.content", "variant").alias("content"))
    return unnest(lines, "line_id", F.col("content"), tool_result_content(), columns)


def _text(path: str) -> Column:
    return F.coalesce(F.try_variant_get("part", path, "string"), F.lit(""))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = transcript_parts(spark, sf_dir, {"part_type": _text("$.type"), "part_name": _text("$.name")})
    return got.select("line_id", "part_path", "part_type", "part_name")


def p6_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child table: part_id and parent_id are surrogate keys; parent_id is null for top parts, whose parent is the line."""
    at = lambda p: F.concat_ws("/", F.col("line_id").cast("string"), p)
    body = F.coalesce(F.try_variant_get("part", "$.input", "variant"), F.try_variant_get("part", "$.source", "variant"))
    call = F.coalesce(F.try_variant_get("part", "$.id", "string"), F.try_variant_get("part", "$.tool_use_id", "string"))
    parts = transcript_parts(spark, sf_dir, {"part_type": _text("$.type"), "part_name": _text("$.name"), "part_text": F.try_variant_get("part", "$.text", "string"), "call_id": call, "body": F.to_json(body)})
    return parts.select("line_id", at("part_path").alias("part_id"), F.when(F.col("parent_path") != "", at("parent_path")).alias("parent_id"), "level", "ordinal", "part_type", "part_name", "part_text", "call_id", "body")


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent table: one row for each line, state record, damaged or not a record."""
    lines = table(spark, sf_dir, "transcript_lines").select("line_id", "session_id", "line_no", "raw", record(F.col("raw")).alias("r"), whole_json(F.col("raw")).alias("w"))
    get = lambda p: F.try_variant_get("r", p, "string")
    state = F.when(F.col("r").isNotNull(), "record").when(F.col("w").isNull(), "damaged").otherwise("other")
    return lines.select("line_id", "session_id", "line_no", state.alias("state"), get("$.role").alias("role"), get("$.type").alias("type"), get("$.error").alias("error"), get("$.parentMessageId").alias("parent_message_id"), F.try_variant_get("r", "$.isSidechain", "boolean").alias("is_sidechain"))
