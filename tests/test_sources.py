import hashlib
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from convoloom.operators.kvstore import belongs_to, bubble_counts, composer_records, live_sessions, richest_payload
from convoloom.operators.transcripts import line_facts, transcript_states
from convoloom.sources.archive import read_backups, safe_name, write_backup
from convoloom.sources.jsonl import read_meta_files, read_transcripts
from convoloom.sources.kvsqlite import read_kv, write_kv
from convoloom.sources.storedb import leaf_object, read_store


def kv_file(path, rows, table="ItemTable"):
    con = sqlite3.connect(path)
    con.execute(f"CREATE TABLE {table} (key TEXT, value BLOB)")
    con.executemany(f"INSERT INTO {table} VALUES (?, ?)", rows)
    con.commit()
    con.close()


def test_kv_scan(spark, tmp_path):
    rows = [(f"bubbleId:s{i % 3}:{i}", f'{{"text":"{i}"}}') for i in range(700)] + [("bubbleId:S1:x", None), ("composerData:s1", '{"name":"ü"}'), ("composerData:s2", "{bad"), ("composerData:s9", '{"name":"none"}'), ("composerData:s0", "[]")]
    kv_file(tmp_path / "state.vscdb", rows)
    load = lambda: read_kv(spark, str(tmp_path), pageRows=100)
    assert [(r["key"], r["value"]) for r in load().orderBy("rowid").collect()] == rows
    assert load().where("value is null").select("key").collect()[0][0] == "bubbleId:S1:x"
    assert load().where("key = 'composerData:s1'").first()["value"] == '{"name":"ü"}' and load().where("key = 'composerData:s1'").first()["byte_length"] == 13
    assert load().where(F.startswith("key", F.lit("bubbleId:s1:"))).count() == 233
    assert {r["session_id"]: r["n_bubbles"] for r in bubble_counts(load()).collect()} == {"s0": 234, "s1": 233, "s2": 233, "S1": 1}
    assert [tuple(r) for r in live_sessions(load(), load()).collect()] == [("s1", "ü", 233)]
    assert composer_records(load()).count() == 2
    assert read_kv(spark, str(tmp_path), table="Other").count() == 0
    with pytest.raises(Exception, match="no table name"):
        read_kv(spark, str(tmp_path), table="x; drop").count()


def test_long_session_ids_stay_whole(spark):
    long = "s" * 300
    kv = spark.createDataFrame([(f"composerData:{long}", '{"name": "t"}'), (f"bubbleId:{long}:b", "{}")], "key string, value string")
    assert [tuple(r) for r in live_sessions(kv, kv).collect()] == [(long, "t", 1)]


def test_kv_filters_reach_the_file(spark, tmp_path):
    kv_file(tmp_path / "a.vscdb", [("k1", "v"), ("k2", "w")])
    plan = read_kv(spark, str(tmp_path)).where("key = 'k1'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull(key" not in plan or "key = k1" not in plan.replace("#", " ")


def test_kv_bad_text(spark, tmp_path):
    kv_file(tmp_path / "a.vscdb", [("k", b"\xff\xfe")])
    with pytest.raises(Exception, match="not UTF-8"):
        read_kv(spark, str(tmp_path)).select("value").collect()
    assert read_kv(spark, str(tmp_path), ["key", "byte_length"]).collect()[0]["byte_length"] == 2


def test_kv_round_trip(spark, tmp_path):
    df = spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("value"))
    write_kv(df, str(tmp_path / "out"))
    assert sorted((r["key"], r["value"] or "") for r in read_kv(spark, str(tmp_path / "out")).collect()) == sorted((r["key"], r["value"] or "") for r in df.collect())


def test_payload_choice(spark):
    df = spark.createDataFrame([("f", "a", "[1]"), ("f", "b", "[1,2]"), ("f", "c", "[3,4]"), ("g", "a", "bad"), ("g", "z", "[1]")], "file string, key string, value string")
    got = richest_payload(df, ["a", "b", "c"], F.size(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")))
    assert [tuple(r) for r in got.collect()] == [("f", "b", "[1,2]")]


def test_workspace_of_a_record(spark):
    rows = [('{"workspaceIdentifier":{"id":"w"}}',), ('{"workspaceIdentifier":{"uri":{"external":"file:///p"}}}',), ('{"workspaceUri":"file:///q"}',), ("{}",)]
    df = spark.createDataFrame(rows, "raw string").select(belongs_to(F.parse_json("raw"), "w", "/p").alias("b"))
    assert [r["b"] for r in df.collect()] == [True, True, False, False]


def blob_id(data):
    return hashlib.sha256(data).hexdigest()


def store(path, leaves, missing=(), extra=None):
    blobs = {}

    def put(data):
        blobs[blob_id(data)] = data
        return blob_id(data)

    ids = [put(leaf if isinstance(leaf, bytes) else json.dumps(leaf).encode()) for leaf in leaves]
    half = len(ids) // 2
    sub = put(b"".join(b"\x0a\x20" + bytes.fromhex(i) for i in ids[half:]))
    root = put(b"\x99" + b"".join(b"\x0a\x20" + bytes.fromhex(i) for i in ids[:half]) + (b"\x12\x20" + bytes.fromhex(sub)) * 2)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE meta (key TEXT, value TEXT)")
    con.execute("CREATE TABLE blobs (id TEXT, data BLOB)")
    con.execute("INSERT INTO meta VALUES ('0', ?)", (json.dumps({"latestRootBlobId": root, "name": "n", "createdAt": 5}).encode().hex(),))
    con.executemany("INSERT INTO blobs VALUES (?, ?)", [(k, v) for n, (k, v) in enumerate(blobs.items()) if k not in {ids[i] for i in missing}])
    con.commit()
    con.close()


def test_store_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    wrapped = json.dumps({"role": "user", "content": "in a record"}).encode()
    leaves = [
        {"role": "system", "content": "s"},
        {"role": "user", "content": "q"},
        {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool-call", "toolCallId": "t1", "toolName": "run", "args": {"x": 1}}]},
        {"role": "tool", "content": [{"type": "tool-result", "toolCallId": "t1", "result": {"ok": True}}]},
        b"\x08\x01\x22" + bytes([len(wrapped)]) + wrapped,
        {"role": "assistant", "tool_calls": [{"id": "t2", "function": {"name": "f", "arguments": "{bad"}}]},
        {"role": "tool", "tool_call_id": "t2", "error": "boom"},
    ]
    store(tmp_path / "a" / "store.db", leaves)
    store(tmp_path / "b" / "store.db", [*leaves[:2], {"role": "user", "content": "lost"}], missing=[2])
    got = read_store(spark, str(tmp_path)).orderBy("file", "ordinal").collect()
    a = [r for r in got if "/a/" in r["file"]]
    assert [(r["role"], r["content"]) for r in a] == [("user", "q"), ("assistant", "a"), ("user", "in a record"), ("assistant", "")]
    assert json.loads(a[1]["tools"]) == [{"name": "run", "status": "completed", "params": {"x": 1}, "result": '{"ok":true}'}]
    assert json.loads(a[3]["tools"]) == [{"name": "f", "status": "error", "params": {"_raw": "{bad"}, "error": "boom"}]
    assert all(r["complete"] and r["name"] == "n" and r["created_at"] == 5 for r in a)
    b = [r for r in got if "/b/" in r["file"]]
    assert [(r["content"], r["complete"]) for r in b] == [("q", False)]


def test_damaged_leaves():
    for bad in (b"", b"{", b"\x0a", b"\x22\xff", b"\x0b", b"[1]"):
        assert leaf_object(bad) is None


def test_backups(spark, tmp_path):
    write_backup(str(tmp_path / "good.zip"), {"a/x.db": ("global-db", b"data"), "b.json": ("workspace-json", b"{}")})
    with pytest.raises(FileExistsError):
        write_backup(str(tmp_path / "good.zip"), {})
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"files": [{"path": "x", "size": 1, "checksum": "sha256:0", "type": "t"}, {"path": "gone", "size": 1, "checksum": "", "type": "t"}]}))
        z.writestr("x", "y")
        z.writestr("more", "z")
    (tmp_path / "no.zip").write_bytes(b"not a zip")
    got = {(r["archive"].rpartition("/")[2], r["path"]): (r["state"], r["content"]) for r in read_backups(spark, str(tmp_path), contents="true").collect()}
    assert got == {("good.zip", "a/x.db"): ("valid", bytearray(b"data")), ("good.zip", "b.json"): ("valid", bytearray(b"{}")), ("bad.zip", "x"): ("corrupt", None), ("bad.zip", "gone"): ("missing", None), ("bad.zip", "more"): ("extra", None), ("no.zip", "manifest.json"): ("corrupt", None)}
    for name in ("../x", "/x", "a/../../b", "c:/x"):
        with pytest.raises(ValueError):
            safe_name(name)


def test_transcripts(spark, tmp_path):
    d = tmp_path / "p" / "agent-transcripts"
    d.mkdir(parents=True)
    lines = ['\ufeff{"role":"user","message":{"content":[{"type":"text","text":"a"}]}}', "", '{"type":"error","error":"e"}\r', '{"role":"system"}', "{bad", '{"role":"assistant","message":{"content":[{"type":"tool_use","name":"r"},{"type":"image"}]}}']
    (d / "t.jsonl").write_text("\n".join(lines), encoding="utf8")
    (d / "u.jsonl").write_text('{"type":"error"}\n', encoding="utf8")
    (tmp_path / "p" / "meta.json").write_text('{"title":"x"}')
    got = read_transcripts(spark, str(tmp_path))
    assert [r["line_no"] for r in got.where("file like '%t.jsonl'").orderBy("line_no").collect()] == [1, 3, 4, 5, 6]
    facts = line_facts(got, ["file", "line_no"])
    assert [r["kind"] for r in facts.where("file like '%t.jsonl'").orderBy("line_no").collect()] == ["message", "error", "ignored", "malformed", "message"]
    assert {r["file"][-7:]: r["state"] for r in transcript_states(facts, "file").collect()} == {"t.jsonl": "partial", "u.jsonl": "error-only"}
    assert read_meta_files(spark, str(tmp_path)).count() == 1
