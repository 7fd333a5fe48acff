import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convoloom.operators.nested import record, tool_result_content, unnest


def parts(spark, rows):
    df = spark.createDataFrame(rows, "line_id bigint, raw string, part string, level int")
    got = unnest(df.select("line_id", record(F.col("raw")).alias("r")), "line_id", F.try_variant_get("r", "$.message.content", "variant"), tool_result_content())
    return sorted((r[0], r[1], r[2] or "") for r in got.select("line_id", "part_path", F.try_variant_get("part", "$.type", "string")).collect())


def brute(rows):
    out = []

    def walk(line, content, pre):
        if isinstance(content, str):
            out.append((line, f"{pre}0", "text"))
        for i, x in enumerate(content if isinstance(content, list) else []):
            kind = x.get("type") if isinstance(x, dict) else None
            out.append((line, f"{pre}{i}", "" if kind is None else kind))
            if kind == "tool_result":
                walk(line, x.get("content"), f"{pre}{i}.")

    for line, raw, *_ in rows:
        try:
            v = json.loads(raw)
            v = json.loads(v) if isinstance(v, str) else v
        except (ValueError, TypeError):
            continue
        if isinstance(v, dict) and isinstance(v.get("message"), dict):
            walk(line, v["message"].get("content"), "")
    return sorted(out)


def rows_of(contents):
    return [(i, json.dumps({"message": {"content": c}}), None, i) for i, c in enumerate(contents)]


def test_depth_strings_nulls_and_wrapping(spark):
    deep = [{"type": "text", "text": "x"}]
    for _ in range(7):
        deep = [{"type": "tool_result", "content": deep}, None]
    rows = rows_of(["plain", deep, [], None, [{"type": "tool_result", "content": "s"}, {"type": "tool_use", "input": {"content": [{"type": "text"}]}}, 5, "t", [1]]])
    rows.append((90, json.dumps(rows[1][1]), None, 0))
    rows += [(91, '{"message":{"content":[]', None, 0), (92, None, None, 0), (93, "", None, 0), (94, "[]", None, 0), (95, '{"message":{"content":["a"]}} tail', None, 0), (96, '{"message":null}', None, 0), (97, json.dumps({"message": {"content": "y" * 300000}}), None, 0)]
    rows += [rows[0]]  # a repeated row gives its parts again
    want = brute([r for r in rows if r[0] != 95])
    assert parts(spark, rows) == want


def test_empty(spark):
    assert parts(spark, []) == []


part = st.recursive(st.one_of(st.none(), st.fixed_dictionaries({"type": st.sampled_from(["text", "tool_use", "image"])})), lambda c: st.fixed_dictionaries({"type": st.just("tool_result"), "content": st.lists(c, max_size=3)}), max_leaves=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(part, max_size=4), min_size=1, max_size=5))
def test_any_nesting(spark, contents):
    rows = rows_of(contents)
    assert parts(spark, rows) == brute(rows)
