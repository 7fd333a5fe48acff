import os

import pytest
from pyspark.sql import functions as F

from convoloom import api
from convoloom.__main__ import parser
from convoloom.config import ConfigError, Options, ReadLimits, parse_limits
from convoloom.operators.snapshots import SnapshotInvalid
from convoloom.sources.archive import write_backup


@pytest.fixture(scope="module")
def archive(spark, sf):
    return api.Archive(spark, sf)


def with_options(archive, **o):
    return api.Archive(archive.spark, archive.path, Options(**o))


def test_pages(archive):
    cat = archive.catalog().orderBy("index").collect()
    assert [r["index"] for r in cat] == list(range(1, len(cat) + 1)) and all(a["created_ms"] >= b["created_ms"] for a, b in zip(cat, cat[1:]))
    page = with_options(archive, limit=5, offset=3)
    assert [r["session_id"] for r in page.list_session_summaries().collect()] == [r["session_id"] for r in cat[3:8]]
    assert page.pagination() == {"total": len(cat), "limit": 5, "offset": 3, "has_more": True}
    assert [r["index"] for r in page.list_sessions().collect()] == [r["index"] for r in cat[3:8] if r["state"] == "resolved"]


def test_opening(archive):
    cat = archive.catalog().collect()
    row = next(r for r in cat if r["state"] == "resolved")
    by_id, by_index = (archive.get_session(x) for x in (row["session_id"], row["index"] - 1))
    assert by_id.select("msg_id").collect() == by_index.select("msg_id").collect() != []
    only = with_options(archive, message_types=("user",)).get_session(row["session_id"])
    assert {r["type"] for r in only.collect()} <= {"user"}
    with pytest.raises(api.SessionNotFound):
        archive.get_session("nobody")
    with pytest.raises(api.SessionNotFound):
        archive.get_session(10**6)
    unsure = [r for r in cat if r["state"] == "ambiguous"]
    if unsure:
        with pytest.raises(api.SessionAmbiguous):
            archive.get_session(unsure[0]["session_id"])


def test_search(archive):
    got = with_options(archive, limit=3, context=1).search("the error").collect()
    assert got and all("the error" in r["line"]["line"].lower() for r in got) and len({r["session_id"] for r in got}) <= 3
    assert archive.search("").count() == 0 and archive.search("no such words anywhere").count() == 0


def test_scope(archive):
    first = archive.list_workspaces().first()["workspace"]
    scoped = with_options(archive, workspace=first)
    assert 0 < scoped.catalog().count() < archive.catalog().count()
    assert with_options(archive, workspace="/not/there").catalog().count() == 0


def test_export_backup_restore(archive, tmp_path):
    sid = archive.catalog().where("state = 'resolved'").first()["session_id"]
    archive.export_markdown(str(tmp_path / "md"), sid)
    archive.export_json(str(tmp_path / "json"), sid)
    assert next((tmp_path / "md").glob("session_id=*/*.txt")).read_text().startswith("# ") and next((tmp_path / "json").glob("session_id=*/*.txt")).read_text().startswith("{")
    facts = archive.backup(str(tmp_path / "b"))
    assert len(facts) == 5 and api.validate_backup(archive.spark, str(tmp_path / "b"), "messages").first()["status"] == "valid"
    assert api.restore_backup(archive.spark, str(tmp_path / "b"), "workspaces", str(tmp_path / "w")).count() == 240
    for n, name in enumerate("bac"):
        write_backup(str(tmp_path / f"{name}.zip"), {"a": ("t", b"1")})
        os.utime(tmp_path / f"{name}.zip", (10**9 + n, 10**9 + n))
    got = api.list_backups(archive.spark, str(tmp_path)).collect()
    assert [(r["archive"][-5:], r["status"]) for r in got] == [("c.zip", "valid"), ("a.zip", "valid"), ("b.zip", "valid")]
    back = api.open_backup(archive.spark, str(tmp_path / "b"))
    assert [tuple(r) for r in back.get_session(sid).collect()] == [tuple(r) for r in archive.get_session(sid).collect()] != []
    part = next((tmp_path / "b" / "messages" / "data").glob("*.parquet"))
    part.unlink()
    with pytest.raises(SnapshotInvalid):
        api.open_backup(archive.spark, str(tmp_path / "b"))


def test_migrate(archive):
    plan = archive.migrate_workspace("/srv", "/data/srv")
    moved = archive.migrate_workspace("/srv", "/data/srv", dry_run=False)
    ids = {r["id"] for r in plan.collect()}
    assert ids and {r["id"] for r in moved.where("workspace like '/data/srv/%'").collect()} == ids


def test_sessions_move_together_or_not_at_all(archive):
    from convoloom.operators.snapshots import MigrationRefused, eligibility

    why = {r["id"]: r["eligibility"] for r in eligibility(api.instances(archive.spark, archive.path)).collect()}
    good = sorted(i for i, e in why.items() if e == "eligible")[:2]
    bad = next(i for i, e in why.items() if e not in ("eligible", "unbound"))
    plan, state = archive.migrate_sessions(good, "/new/place/")
    assert {r["id"]: r["moved"] for r in plan.collect()} == dict.fromkeys(good, "/new/place")
    new, _ = archive.migrate_sessions(good, "/new/place", dry_run=False, expected=state)
    assert {r["id"] for r in new.where("workspace = '/new/place'").collect()} == set(good)
    for ids in ([*good, bad], [*good, "nobody"]):
        with pytest.raises(MigrationRefused):
            archive.migrate_sessions(ids, "/new/place")
    with pytest.raises(MigrationRefused, match="changed"):
        archive.migrate_sessions(good, "/new/place", dry_run=False, expected="1-1-1")


def test_both_recordings_are_one_message(archive):
    from convoloom.operators.messages import messages

    state = {r["session_id"]: r["state"] for r in archive.catalog().collect()}
    for r in messages(archive.spark, archive.path).groupBy("session_id").agg(F.count_distinct("stack").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("n"), "session_id").collect():
        if state.get(r["session_id"]) == "resolved":
            got = archive.get_session(r["session_id"]).collect()
            assert {x["source"] for x in got} & {"both", "composer", "store"} and [x["pos"] for x in got if x["pos"]] == sorted(x["pos"] for x in got if x["pos"])
            held = {i for x in got for i in (x["msg_id"], x["composer_msg"], x["store_msg"]) if i is not None}
            assert len(held) == r["rows"]
            break


def test_limits():
    assert parse_limits(["jsonlRecordBytes=1KiB", "zip_entry_count=5"]) == ReadLimits.of(jsonl_record_bytes=1024, zip_entry_count=5)
    for bad in (["x=1"], ["zipEntryCount=0"], ["zipEntryCount"], ["zipEntryCount=1", "zip_entry_count=2"], ["jsonlRecordBytes=5GiB"], ["zipEntryCount=1=2"]):
        with pytest.raises(ConfigError):
            parse_limits(bad)
    for bad in ({"limit": 0}, {"offset": -1}, {"context": 1.5}, {"workspace": ""}, {"workspace": "a\nb"}, {"limit": True}):
        with pytest.raises(ConfigError):
            Options(**bad)


def test_commands():
    a = parser().parse_args(["--data-path", "x", "search", "q", "-n", "0"])
    assert a.command == "search" and a.n == 0 and a.c == 50
    a = parser().parse_args(["--data-path", "x", "--json", "show", "3", "--tool", "--short"])
    assert a.json and a.tool and a.short and not a.think
