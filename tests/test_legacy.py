import json

from pyspark.sql import functions as F

from convoloom.operators.legacy import attach_generations, composer_heads, descriptor_path, layout, legacy_messages, legacy_sessions


def frame(spark, *values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "k int, raw string")


def test_sessions_and_messages(spark):
    old = {"tabs": [{"id": "a", "title": "t", "lastSendTime": 5, "bubbles": [{"type": "ai", "text": "x", "createdAt": 7}, {"id": "", "role": "System", "content": None}, {"id": "m", "type": "user"}]}, {"id": "none", "bubbles": []}, {"id": "null"}]}
    new = {"chatSessions": [{"id": "b", "createdAt": "1700000000000", "lastUpdatedAt": "2023-11-14T22:13:20.000Z", "messages": [{"id": "1", "role": "user", "content": "q", "timestamp": 1}]}]}
    df = frame(spark, old, new, "{bad", None, [], {"chatSessions": []})
    s = legacy_sessions(df, "k", "raw")
    assert sorted((r["k"], r["session_id"], r["title"], r["created_ms"], r["updated_ms"]) for r in s.collect()) == [(0, "a", "t", None, 5), (1, "b", None, 1700000000000, 1700000000000)]
    m = legacy_messages(s, "k")
    assert sorted((r["k"], r["message_no"], r["message_id"], r["role"], r["content"], r["ms"]) for r in m.collect()) == [(0, 0, "msg:0", "assistant", "x", 7), (0, 1, "msg:1", "assistant", "", None), (0, 2, "m", "user", "", None), (1, 0, "1", "user", "q", 1)]
    assert [r[0] for r in df.orderBy("k").select(layout(F.try_parse_json("raw"))).collect()] == ["sessions", "sessions", None, None, "heads", "sessions"]


def test_heads_and_generations(spark):
    df = frame(spark, {"allComposers": [{"composerId": "a", "name": "n", "createdAt": 10, "lastUpdatedAt": 20}, {"composerId": "a"}, {"composerId": ""}], "selectedComposerIds": ["z"]}, [{"composerId": "b"}], {"selectedComposerIds": ["c", "c"]}, {})
    heads = composer_heads(df, "k", "raw")
    assert sorted((r["k"], r["composer_id"]) for r in heads.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    gens = spark.createDataFrame([(0, 9, "x"), (0, 60_020, "y"), (0, 60_021, "z"), (1, 5, "w")], "k int, ms bigint, text string")
    assert sorted(r["text"] for r in attach_generations(heads, gens, "k").collect()) == ["w", "y"]


def test_descriptors(spark):
    df = frame(spark, {"folder": "file:///a%20b"}, {"workspace": "file:///c/x.code-workspace"}, {}, "{bad")
    assert [r[0] for r in df.orderBy("k").select(descriptor_path(F.col("raw"))).collect()] == ["/a b", "/c/x.code-workspace", None, None]
