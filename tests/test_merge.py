import itertools
import random

from hypothesis import given
from hypothesis import strategies as st

from convoloom.operators import merge as m


def slow(a, b):
    n, k = len(a), len(b)
    best = [[0] * (k + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(k)):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < k:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_all_short_sequences():
    seqs = [s for n in range(6) for s in itertools.product("AB", repeat=n)]
    for a in seqs:
        for b in seqs:
            assert m.lcs_pairs(a, b) == slow(a, b)


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_longer_sequences(a, b):
    assert m.lcs_pairs(a, b) == slow(a, b)


def test_large_inputs_keep_order(monkeypatch):
    monkeypatch.setattr(m, "LARGE", 10)
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(80) for _ in range(rng.randrange(60))] for _ in range(2))
        got = m.anchored_pairs(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        union = m.align(a, b, lambda x: x, lambda i, j, end: next((n for n in range(j, end) if abs(a[i] - b[n]) < 5), None))
        assert [i for i, _ in union if i is not None] == list(range(len(a))) and [j for _, j in union if j is not None] == list(range(len(b)))


@given(st.lists(st.integers(0, 9), max_size=40), st.lists(st.integers(0, 9), max_size=40))
def test_thresholds_and_bits_agree(a, b):
    assert m.anchored_pairs(a, b) == slow(a, b)


def test_a_moved_unique_key_costs_no_pairs():
    n = 20_001
    got = m.anchored_pairs(["U"] + ["R"] * n, ["R"] * n + ["U"])
    assert len(got) == n and all(q == p - 1 for p, q in got)
    rng = random.Random(2)
    a = list(range(50_000))
    b = [i for i in a if rng.random() < 0.9]
    moved = [b[-1], *b[:-1]]
    assert len(m.anchored_pairs(a, moved)) == len(b) - 1


def test_gaps_pair_fillable_messages():
    composer = [{"id": "c1", "role": "user", "content": "hi"}, {"id": "c2", "role": "assistant", "content": "[empty message]"}, {"id": "c3", "role": "user", "content": "bye"}]
    store = [{"role": "user", "content": "<user_query>hi</user_query>", "ms": 5}, {"role": "assistant", "content": "text"}, {"role": "assistant", "content": "more"}, {"role": "user", "content": "bye"}]
    got = m.merge_conversation(composer, store)
    assert [(x.get("id"), x["content"], x["source"]) for x in got] == [("c1", "hi", "both"), ("c2", "text", "both"), (None, "more", "store"), ("c3", "bye", "both")]
    assert got[0]["ms"] == 5


def test_tools_decide():
    a = {"role": "assistant", "content": "", "tools": [{"name": "read", "params": {"p": 1}}]}
    assert m.messages_fit(a, {**a, "tools": [{"name": "read", "params": {"p": 1.0}}]})
    assert not m.messages_fit(a, {**a, "tools": [{"name": "read", "params": {"p": 2}}]})
    assert m.messages_fit(a, {**a, "tools": [{"name": "read"}]})
    assert m.pair_tools([{"name": "x", "id": "1"}, {"name": "x"}], [{"name": "x"}, {"name": "x", "id": "1"}]) == [(0, 1), (1, 0)]
    got = m.merge_tools([{"name": "x", "status": "completed"}], [{"name": "x", "status": "completed", "result": "r", "id": "7"}, {"name": "y", "status": "error"}], "composer")
    assert got == [{"name": "x", "status": "completed", "result": "r", "id": "7"}, {"name": "y", "status": "error"}]


def test_corrupt_pairs_only_with_corrupt():
    bad, empty = {"role": "user", "content": "[corrupted message]"}, {"role": "user", "content": ""}
    assert m.messages_fit(bad, bad) and not m.messages_fit(bad, empty) and m.messages_fit(empty, {"role": "user", "content": "x"})


def test_stacks_on_frames(spark):
    rows = [("s", 1, "both", "user", 1, "real"), ("s", 2, "composer", "assistant", 2, "real"), ("s", 3, "store", "assistant", 3, "real"), ("s", 4, "both", "user", 4, "real"), ("t", 5, "store", "user", 1, "empty")]
    df = spark.createDataFrame(rows, "session_id string, msg_id bigint, stack string, role string, key bigint, class string")
    got = sorted((r["session_id"], r["pos"], r["composer_msg"], r["store_msg"], r["source"]) for r in m.align_stacks(df).collect())
    assert got == [("s", 1, 1, 1, "both"), ("s", 2, 2, None, "composer"), ("s", 3, None, 3, "store"), ("s", 4, 4, 4, "both"), ("t", 1, None, 5, "store")]
    assert m.align_stacks(df.limit(0)).count() == 0


def test_long_sessions_on_frames(spark):
    n = 20_001
    rows = spark.range(n).selectExpr("'s' as session_id", "id + 1 as msg_id", "'both' as stack", "'user' as role", "7L as key", "'real' as class")
    ends = spark.createDataFrame([("s", 0, "composer", "user", 8, "real"), ("s", n + 1, "store", "user", 8, "real"), (None, 1, "both", "user", 1, "real")], "session_id string, msg_id bigint, stack string, role string, key bigint, class string")
    got = {(r["session_id"], r["source"]): r["count"] for r in m.align_stacks(rows.union(ends)).groupBy("session_id", "source").count().collect()}
    assert got == {("s", "both"): n, ("s", "composer"): 1, ("s", "store"): 1, (None, "both"): 1}


def test_marks_are_those_of_own_calls():
    call = {"name": "read_file"}
    assert m.is_tool_mark({"content": " [Tool: read_file]\nFile: x", "tools": [call]})
    assert not m.is_tool_mark({"content": "[Tool: other thing]", "tools": [call]}) and not m.is_tool_mark({"content": "[Tool: read_file]"})


def test_attachments_of_both_sides():
    block = lambda x: f"```{m.ATTACHMENT}\n{x}\n```"
    c, s = {"id": "c", "role": "user", "content": "see\n" + block("QUE=")}, {"role": "user", "content": "see\n" + block("QkI=") + "\n" + block("QUE=")}
    assert [x["content"] for x in m.merge_conversation([c], [s])] == ["see\n" + block("QUE=") + "\n" + block("QkI=")]
    only = {"role": "user", "content": block("QUE=")}
    assert m.message_key(only) == ("user", ("QUE=",), ()) and m.message_key({"role": "user", "content": ""}) is None
    assert m.joined_attachments("other", "text\n" + block("QUE="), "composer") is None


def test_tools_pair_in_three_rounds_against_a_scan():
    rng = random.Random(3)
    tool = lambda: {"name": rng.choice("xy"), **({"id": rng.choice("12")} if rng.random() < 0.4 else {}), **({"params": {"p": rng.randrange(2)}} if rng.random() < 0.6 else {})}
    tests = (lambda x, y: x.get("id") and x.get("id") == y.get("id"), lambda x, y: "params" in x and x.get("params") == y.get("params"), lambda x, y: "params" not in x or "params" not in y)
    for _ in range(300):
        a, b = ([tool() for _ in range(rng.randrange(6))] for _ in range(2))
        want, used = {}, set()
        for fits in tests:
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if i not in want and j not in used and x["name"] == y["name"] and fits(x, y):
                        want[i] = j
                        used.add(j)
        assert m.pair_tools(a, b) == sorted(want.items())


def test_merged_sessions_against_python(spark, sf):
    """Every session of the archive, merged message by message in Python, from planted pairs too."""
    from collections import defaultdict

    from convoloom.operators.messages import messages
    from convoloom.operators.timeline import timed_messages
    from pyspark.sql import functions as F

    rows = messages(spark, sf).select("session_id", "msg_id", "stack", "role", "content", "message_key", "model")
    block = f"```{m.ATTACHMENT}\n%s\n```"
    planted = [("p", 1, "composer", "user", "look\n" + block % "QUE=", "k1", None), ("p", 2, "store", "user", "<user_query>look</user_query>\n" + block % "QkI=", None, "m1"), ("p", 3, "composer", "assistant", "[empty message]", "k3", "m2"), ("p", 4, "store", "assistant", "done", None, "m3"), ("p", 5, "store", "user", "[corrupted message]", None, None), ("p", 6, "composer", "user", "[corrupted message]", "k6", None), ("p", 7, "store", "user", None, "", "m7")]
    rows = rows.unionByName(spark.createDataFrame([(k, 10**12 + i, *r) for k, i, *r in planted], rows.schema))
    timed = timed_messages(spark, sf)
    times = {r["msg_id"]: (r["ms"], r["source"]) for r in timed.where("ms is not null").collect()}
    sides = defaultdict(lambda: ([], []))
    for r in rows.orderBy("msg_id").collect():
        ms, source = times.get(r["msg_id"], (None, None))
        d = {"msg": r["msg_id"], "role": r["role"], "content": r["content"], "message_key": r["message_key"], "model": r["model"], "ms": ms, "ms_source": source}
        for side, name in zip(sides[r["session_id"]], ("composer", "store")):
            if r["stack"] in (name, "both"):
                side.append({**d, f"{name}_msg": r["msg_id"]})
    want = set()
    for session, (c, s) in sides.items():
        for n, x in enumerate(m.merge_conversation(c, s)):
            want.add((session, n + 1, x.get("composer_msg"), x.get("store_msg"), x["source"], x["role"], x.get("message_key") or None, x["content"], x.get("model"), x.get("ms"), x.get("ms_source")))
    got = [tuple(r) for r in m.merged_messages(rows, timed).collect()]
    assert len(got) == len(set(got)) and set(got) == want
