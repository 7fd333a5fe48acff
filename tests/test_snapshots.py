import pytest

from convoloom.operators import snapshots as s
from convoloom.operators.export import decode_attachments, encode_attachment, markdown_message, without_attachments, write_blocks
from convoloom.operators.replicas import arbitrate, canonical_paths, memberships, replica_groups
from convoloom.operators.timeline import fill_times
from convoloom.streaming.incremental import SessionStore, current_sessions
from pyspark.sql import functions as F

INSTANCES = "id string, session_row_id bigint, role string, representation string, tier string, workspace string, fingerprint string"


def copies(spark, rows):
    return spark.createDataFrame(rows, INSTANCES)


def test_publish_validate_restore(spark, tmp_path):
    df = spark.range(20).withColumn("x", F.col("id") * 2)
    facts = s.publish(df, str(tmp_path / "snap"))
    assert facts["files"] > 0 and s.verdict(s.validate(spark, str(tmp_path / "snap"))).first()["status"] == "valid"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        s.publish(df, str(tmp_path / "snap"))
    assert s.restore(spark, str(tmp_path / "snap"), str(tmp_path / "back")).count() == 20
    part = next((tmp_path / "snap" / "data").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"?")
    for crc in (tmp_path / "snap" / "data").glob(".*.crc"):
        crc.unlink()
    assert s.verdict(s.validate(spark, str(tmp_path / "snap"))).first()["status"] == "warnings"
    part.unlink()
    with pytest.raises(s.SnapshotInvalid):
        s.restore(spark, str(tmp_path / "snap"), str(tmp_path / "again"))


def test_corrupt_files_are_never_restored(spark, tmp_path):
    snap = tmp_path / "snap"
    s.publish(spark.range(10, numPartitions=2), str(snap))
    parts = sorted((snap / "data").glob("*.parquet"))
    assert len(parts) == 2
    # the second file's rows in place of the first's, and a file that nobody listed
    parts[0].write_bytes(parts[1].read_bytes())
    (snap / "data" / "part-extra.parquet").write_bytes(parts[1].read_bytes())
    for crc in (snap / "data").glob(".*.crc"):
        crc.unlink()
    assert {r["state"]: r["count"] for r in s.validate(spark, str(snap)).groupBy("state").count().collect()} == {"corrupt": 1, "valid": 1, "extra": 1}
    with pytest.raises(s.SnapshotInvalid, match=parts[0].name):
        s.restore(spark, str(snap), str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()
    got = [r[0] for r in s.restore(spark, str(snap), str(tmp_path / "b"), partial=True).orderBy("id").collect()]
    assert got == [5, 6, 7, 8, 9]


def test_replicas(spark):
    df = copies(spark, [("a", 1, "composer", "composer-global", "complete", "/p", "f"), ("a", 2, "composer", "composer-global", "complete", "/q", "f"), ("a", 3, "composer", "composer-workspace", "complete", "/o.code-workspace", "g"), ("a", 4, "store", "store-db", "complete", "/a", "h"), ("b", 5, "composer", "composer-workspace", "complete", None, "x"), ("b", 6, "composer", "composer-workspace", "complete", "/b", "y"), ("c", 7, "store", "store-transcript", "partial", "/c", "z")])
    groups = replica_groups(df)
    assert {(r["id"], r["representation"]): (r["state"], r["selected"]) for r in groups.collect()} == {("a", "composer-global"): ("equivalent", 1), ("a", "composer-workspace"): ("single", 3), ("a", "store-db"): ("single", 4), ("b", "composer-workspace"): ("divergent", None), ("c", "store-transcript"): ("single", 7)}
    assert {r["id"]: (r["state"], r["resolution"], r["n_superseded"]) for r in arbitrate(groups, "composer").collect()} == {"a": ("selected", "complete", 1), "b": ("ambiguous", None, 0)}
    assert {(r["id"], r["workspace"]): (r["roles"], r["n_copies"]) for r in memberships(df).collect()}[("a", "/a")] == ("store", 1)
    assert {r["id"]: r["workspace"] for r in canonical_paths(df).collect()} == {"a": "/o.code-workspace", "b": "/b", "c": "/c"}
    assert {r["id"]: r["eligibility"] for r in s.eligibility(df).collect()} == {"a": "merged", "b": "ambiguous", "c": "store-only"}
    assert replica_groups(df.limit(0)).count() == 0


def test_migration(spark):
    df = copies(spark, [("a", 1, "composer", "composer-global", "complete", "/src/x", "f"), ("b", 2, "composer", "composer-global", "complete", "/other", "f")])
    assert [tuple(r) for r in s.migrate_preview(df, "/src", "/dst").collect()] == [("a", "/src/x", "/dst/x")]
    for bad in ("/src", "/src/", "/src/in"):
        with pytest.raises(ValueError):
            s.migrate_preview(df, "/src", bad)
    ids = df.where("id = 'a'").select("id")
    assert sorted(r["workspace"] for r in s.migrate(df, ids, "workspace", "/src", "/dst").collect()) == ["/dst/x", "/other"]
    once, twice = (s.migrate(df, ids, "workspace", "/src", "/dst", copy=True).collect() for _ in range(2))
    assert len(once) == 3 and sorted(map(tuple, once)) == sorted(map(tuple, twice)) and len({r["id"] for r in once}) == 3


def test_budget_and_diagnostics(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "i bigint, n bigint")
    assert s.first_excess(df, ["i"], "n", 50).first()["i"] == 5 and s.first_excess(df, ["i"], "n", 100).count() == 0


def test_gap_fill(spark):
    rows = [("s", 1, None, None), ("s", 2, 20, "composer-created-at"), ("s", 3, 99, None), ("s", 4, None, None), ("s", 5, 50, "composer-timing"), ("s", 6, None, None), ("t", 7, None, None), ("u", 8, None, None)]
    df = spark.createDataFrame(rows, "k string, i bigint, ms bigint, source string").withColumn("anchor", F.when(F.col("k") == "t", 7).cast("bigint"))
    got = {r["i"]: (r["resolved_ms"], r["resolved_source"]) for r in fill_times(df, "k", ["i"], "ms", "source", F.col("anchor")).collect()}
    assert got == {1: (20, "inferred-next"), 2: (20, "composer-created-at"), 3: (99, "unknown"), 4: (50, "inferred-next"), 5: (50, "composer-timing"), 6: (50, "inferred-previous"), 7: (7, "session-fallback"), 8: (0, "unknown")}


def test_incremental_replacement(spark, tmp_path):
    schema = "session_id string, msg_id bigint, role string, content string"
    store = SessionStore(spark, str(tmp_path))
    first = spark.createDataFrame([("a", 1, "user", "x"), ("b", 2, "user", "y")], schema)
    assert store.upsert(first)["written"] == 2 and store.upsert(first) == {"written": 0, "version": 1}
    # a row lands in the middle of a conversation that is known
    assert store.upsert(spark.createDataFrame([("a", 0, "user", "w")], schema)) == {"written": 1, "version": 2}
    assert {r["session_id"]: r["n_messages"] for r in current_sessions(store).collect()} == {"a": 2, "b": 1}


def test_a_store_goes_on_after_a_restart(spark, tmp_path):
    schema = "session_id string, msg_id bigint, role string, content string"
    SessionStore(spark, str(tmp_path)).upsert(spark.createDataFrame([("a", 1, "user", "x"), ("b", 1, "user", "x")], schema))
    again = SessionStore(spark, str(tmp_path))
    assert again.version == 1 and again.upsert(spark.createDataFrame([("b", 2, "user", "y"), ("c", 1, "user", "z")], schema)) == {"written": 2, "version": 2}
    # a version that was cut off before its mark was written doesn't count
    (tmp_path / "versions" / "3").mkdir(parents=True)
    last = SessionStore(spark, str(tmp_path))
    assert last.version == 2 and {r["session_id"]: r["n_messages"] for r in current_sessions(last).collect()} == {"a": 1, "b": 2, "c": 1}
    assert last.upsert(spark.createDataFrame([("c", 1, "user", "new")], schema)) == {"written": 1, "version": 3}
    assert sorted(tuple(r) for r in last.rows().collect()) == [("a", 1, "user", "x"), ("b", 1, "user", "x"), ("b", 2, "user", "y"), ("c", 1, "user", "new")]


def test_only_touched_parts_are_written(spark, tmp_path):
    schema = "session_id string, msg_id bigint, role string, content string"
    store = SessionStore(spark, str(tmp_path), parts=8)
    store.upsert(spark.createDataFrame([(f"s{i}", 1, "user", "x") for i in range(40)], schema))
    store.upsert(spark.createDataFrame([("s1", 2, "user", "y")], schema))
    assert len(list((tmp_path / "rows" / "v=1").glob("part=*"))) > 4 and len(list((tmp_path / "rows" / "v=2").glob("part=*"))) == 1
    assert store.rows().count() == 41 and SessionStore(spark, str(tmp_path)).rows().count() == 41


def test_attachments_and_blocks(spark, tmp_path):
    df = spark.createDataFrame([("päy\nload",), ("",)], "p string").withColumn("c", F.concat(F.lit("t\n"), encode_attachment(F.col("p"))))
    got = df.select(decode_attachments(F.col("c")).alias("d"), without_attachments(F.col("c")).alias("w")).collect()
    assert [list(r["d"]) for r in got][0] == ["päy\nload"] and got[0]["w"] == "t"
    rows = spark.createDataFrame([("s", 1, "user", "k", "hi", 0, "unknown"), ("s", 2, "assistant", None, "yo", 5, "composer-created-at")], "session_id string, msg_id bigint, role string, message_key string, content string, resolved_ms bigint, resolved_source string")
    texts = [r[0] for r in rows.select(markdown_message()).collect()]
    assert texts[0] == "### **User**\n\n**ID**: `k`\n\n**Time**: ≈ 1970-01-01T00:00:00.000Z\n**Time Source**: unknown\n\nhi\n" and "≈" not in texts[1]
    write_blocks(rows.select("session_id", "msg_id", F.col("content").alias("block")), str(tmp_path / "md"))
    assert next((tmp_path / "md" / "session_id=s").glob("*.txt")).read_text() == "hi\nyo\n"
