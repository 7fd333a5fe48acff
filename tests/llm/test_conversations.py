import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from convoloom.llm import conversations as c

MESSAGES = "msg_id bigint, session_id string, workspace_id string, message_key string, parent_key string, role string, content string, msg_time string, received_at timestamp_ntz, tz string, ms string"
START = datetime(2024, 1, 1)


def message(i, session, key=None, parent=None, role="user", content="x", ms=None, day=0):
    return (i, session, "w", key, parent, role, content, None if ms is None else str(1_700_000_000_000 + ms), START + timedelta(days=day, seconds=i), "clash", "clash")


def run(spark, rows, lists=(), parts=1):
    zone = spark.createDataFrame([("w", "UTC")], "workspace_id string, tz string")
    m = c.prepare(spark.createDataFrame(rows, MESSAGES), zone)
    from pyspark.sql import functions as F

    kept = m.groupBy("session_id", "ident").agg(F.min(F.struct("msg_id", "message_key", "parent_key", "role", "blank", "ms", F.unix_millis("arrived").alias("arrived_ms"))).alias("m")).select("session_id", "m.*")
    sessions = spark.createDataFrame(list(lists), "id string, active_branch_bubble_ids array<string>")
    got = defaultdict(list)
    for r in c.rebuild(kept, c.active_branches(sessions)).collect():
        got[r["session_id"]].append((r["pos"], r["msg_id"]))
    return {k: [i for _, i in sorted(v)] for k, v in got.items()}


def pair(s, i, **more):
    return [message(i, s, f"{s}{i}", ms=i, **more), message(i + 1, s, f"{s}{i + 1}", role="assistant", ms=i + 1, **more)]


def test_rules(spark):
    rows = [
        *pair("ok", 1),
        message(5, "two", "a", ms=1), message(6, "two", "b", ms=2), message(7, "two", "c", role="ai", ms=3),
        message(8, "open", "a", ms=1), message(9, "open", "b", role="assistant", ms=2), message(10, "open", "c", ms=3),
        message(11, "late", "a", role=" Assistant", ms=1), message(12, "late", "b", ms=2), message(13, "late", "c", role="2", ms=3),
        message(14, "odd", "a", role="unknown", ms=1), message(15, "odd", "b", role="assistant", ms=2),
        message(16, "none", "a", content=" \n\t", ms=1), message(17, "null", "a", content=None, ms=1),
        message(18, "blank", "a", ms=1), message(19, "blank", "b", content="", role="?", ms=2), message(20, "blank", "c", role="MODEL", ms=3),
        message(21, "many", "a", role="1", ms=1), message(22, "many", "b", role="2", ms=2), message(23, "many", "c", role="2", ms=3),
    ]
    assert run(spark, rows) == {"ok": [1, 2], "blank": [18, 20], "many": [21, 22, 23]}


def test_order_repeats_and_branches(spark):
    rows = [
        # arrival against time, and a message delivered again
        message(4, "s", "u", ms=10), message(2, "s", "v", role="assistant", ms=20), message(9, "s", "u", ms=99, role="assistant"), message(3, "s", None, role="assistant", ms=30), message(1, "s", "", role="assistant", ms=30),
        # a branch that was left, and keys that are missing
        message(10, "b", "x", ms=1), message(11, "b", "y", ms=2), message(12, "b", "z", role="assistant", ms=3), message(13, "b", None, role="assistant", ms=4),
        message(20, "g", "x", ms=1), message(21, "g", "y", role="assistant", ms=2),
    ]
    lists = [("b", ["x", "z", None]), ("b", ["x", "z"]), ("b", None), ("b", []), ("g", ["x", "y", "gone"]), (None, ["q"])]
    assert run(spark, rows, lists) == {"s": [4, 2, 1, 3], "b": [10, 12, 13]}


def test_messages_without_time_follow_their_parents(spark):
    rows = [message(1, "s", "a", ms=5), message(9, "s", "b", "a", "assistant"), message(8, "s", "c", "b", "assistant"), message(2, "s", "d", "a", "assistant"), message(3, "s", "e", role="assistant", ms=6)]
    assert run(spark, rows) == {"s": [1, 2, 9, 8, 3]}
    # circles and lost parents count as sent on arrival, far behind these times
    rows = [message(1, "t", "a", ms=5), message(2, "t", "b", role="assistant", ms=6), message(3, "t", "c", "d"), message(4, "t", "d", "c", "assistant"), message(5, "t", "e", "zzz", "assistant")]
    assert run(spark, rows) == {"t": [1, 2, 3, 4, 5]}


def test_a_long_chain_without_times(spark):
    rows = [message(100, "s", "k0", ms=1)] + [message(100 - i, "s", f"k{i}", f"k{i - 1}", "assistant") for i in range(1, 40)]
    assert run(spark, rows) == {"s": [100 - i for i in range(40)]}

    # the same without a time at its root: as if sent when the root arrived
    rows = [message(1, "t", "a", ms=0)] + [message(50 - i, "t", f"k{i}", f"k{i - 1}" if i else "gone", "assistant") for i in range(9)]
    assert run(spark, rows) == {"t": [1] + [50 - i for i in range(9)]}


def test_hot_session_against_brute_force(spark):
    rng = random.Random(6)
    rows, want = [], defaultdict(list)
    for i in range(1, 900):
        s = "hot" if i % 2 else f"s{rng.randrange(80)}"
        rows.append(message(i, s, f"k{i}", role=rng.choice(["user", "assistant", "assistant"]), ms=rng.randrange(400)))
    for r in rows:
        want[r[1]].append((int(r[7]), r[0], r[5]))
    keep = {}
    for s, xs in want.items():
        xs.sort()
        roles = [x[2] for x in xs]
        if roles[0] == "user" and roles[-1] == "assistant" and not any(a == b == "user" for a, b in zip(roles, roles[1:])):
            keep[s] = [x[1] for x in xs]
    assert run(spark, rows) == keep


def test_empty(spark):
    assert run(spark, []) == {}


def stream_of(spark, tmp_path, batches, lists=(), **more):
    """Runs one micro-batch for each list of rows and gives the stream object and the last query."""
    zone = spark.createDataFrame([("w", "UTC")], "workspace_id string, tz string")
    listed = c.active_branches(spark.createDataFrame(list(lists), "id string, active_branch_bubble_ids array<string>"))
    s = c.ConversationStream(zone, listed, folder=str(tmp_path / "run"), **more)
    d = tmp_path / "messages"
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, MESSAGES).drop("tz", "ms").coalesce(1).write.mode("append").parquet(str(d))
        q = s.start(spark.readStream.schema(spark.read.parquet(str(d)).schema).parquet(str(d)))
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return s, sizes


def by_session(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r["session_id"]].append((r["pos"], r["msg_id"]))
    return {k: [i for _, i in sorted(v)] for k, v in got.items()}


def test_conversations_are_emitted_on_timeout(spark, tmp_path):
    batches = [
        [*pair("a", 1), message(10, "b", "k", ms=1, day=1)],
        [*pair("x", 30, day=40), message(11, "b", "l", role="assistant", ms=2, day=4)],  # a is long over; b got its answer late
        [*pair("y", 40, day=90), message(3, "a", "a3", ms=5, day=89), message(4, "a", "a4", role="assistant", ms=6, day=90)],
    ]
    s, sizes = stream_of(spark, tmp_path, batches, delay="7 days", timeout="10 days")
    out = defaultdict(set)
    for r in s.emitted().collect():
        out[r["batch"]].add(r["session_id"])
    assert [sorted(v) for _, v in sorted(out.items()) if v] == [["a", "b"], ["x"]]
    # state of windows behind the watermark has left the store, so it doesn't grow with the stream
    assert sizes[-1] <= 4
    # y is closed by the end of the input, and a, which got more after it was closed, is made anew
    assert by_session(s.finish()) == {"a": [1, 2, 3, 4], "b": [10, 11], "x": [30, 31], "y": [40, 41]}


def test_repeats_and_lists_through_the_stream(spark, tmp_path):
    batches = [[*pair("a", 1), message(20, "b", "x", ms=1), message(21, "b", "y", role="assistant", ms=2)], [message(7, "a", "a1", ms=999, content="again"), message(19, "b", "y", role="assistant", ms=0)]]
    s, _ = stream_of(spark, tmp_path, batches, lists=[("b", ["x", "y"])])
    # of b's answers the smaller msg_id counts, which is sent before the question
    assert s.emitted().count() == 0 and by_session(s.finish()) == {"a": [1, 2]}


def test_a_stream_without_rows(spark, tmp_path):
    s, _ = stream_of(spark, tmp_path, [])
    assert s.finish().count() == 0


def test_messages_without_arrival(spark, tmp_path):
    rows = [(*r[:8], None, *r[9:]) for r in pair("a", 1)]
    s, _ = stream_of(spark, tmp_path, [rows])
    assert by_session(s.finish()) == {"a": [1, 2]}


def test_archive(spark, sf):
    got = c.p5_found(spark, sf)
    assert got.dtypes == [("session_id", "string"), ("pos", "int"), ("msg_id", "bigint")] and got.count() > 0


@pytest.mark.parametrize("role, who", [("USER ", 1), ("human", 1), ("1", 1), (" ai", 2), ("2", 2), ("Model\n", 2), ("7", 0), ("", 0), (None, 0)])
def test_speakers(spark, role, who):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(role,)], "r string").select(c.speaker(F.col("r"))).first()[0] == who
