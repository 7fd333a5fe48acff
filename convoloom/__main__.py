"""Commands over an archive of tables: list, show, search, export, migrate, migrate-session, backup, restore, list-backups."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from convoloom.api import Archive, list_backups, open_backup, restore_backup
from convoloom.config import Options, parse_limits
from convoloom.functions import text
from convoloom.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="convoloom")
    p.add_argument("--data-path", required=True)
    p.add_argument("--workspace")
    p.add_argument("--json", action="store_true", help="one object around all rows")
    p.add_argument("--source-limit", action="append", default=[])
    p.add_argument("--master", default="local[8]")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("list")
    c.add_argument("-n", type=int, default=20)
    c.add_argument("--all", action="store_true")
    c.add_argument("--workspaces", action="store_true")
    c.add_argument("--ids", action="store_true", help="ids only, one to a line")
    c.add_argument("-b", help="read from this backup")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("-n", type=int, default=10)
    c.add_argument("-c", type=int, default=50, help="characters to both sides of a match")
    c.add_argument("-b", help="read from this backup")
    c = sub.add_parser("show")
    c.add_argument("session")
    c.add_argument("--only", default="")
    c.add_argument("--short", action="store_true", help="cut every message")
    for kind in ("think", "tool", "error"):
        c.add_argument(f"--{kind}", action="store_true", help="show such messages in full")
    c.add_argument("-b", help="read from this backup")
    c = sub.add_parser("export")
    c.add_argument("session", nargs="?")
    c.add_argument("-o", required=True)
    c.add_argument("-f", choices=["md", "json"], default="md")
    c.add_argument("-b", help="read from this backup")
    c = sub.add_parser("migrate")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--copy", action="store_true")
    c.add_argument("-o", help="where the new table of sessions goes; without it a preview is printed")
    c = sub.add_parser("migrate-session")
    c.add_argument("ids", nargs="+")
    c.add_argument("--to", required=True)
    c.add_argument("--copy", action="store_true")
    c.add_argument("--expect", help="the state a preview gave; if the sessions changed since, nothing is written")
    c.add_argument("-o", help="where the new table of sessions goes; without it a preview is printed")
    c = sub.add_parser("backup")
    c.add_argument("target")
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("restore")
    c.add_argument("path")
    c.add_argument("name")
    c.add_argument("target")
    sub.add_parser("list-backups").add_argument("path")
    return p


def emit(df, command: str | None, facts: dict) -> None:
    """Rows as lines of JSON, or, for a command, as the rows of one object that begins with the facts."""
    rows = (json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in df.toLocalIterator())
    if command is None:
        for r in rows:
            print(r)
        return
    print(json.dumps({"command": command, **facts}, ensure_ascii=False)[:-1] + ', "rows": [', end="")
    for n, r in enumerate(rows):
        print(("," if n else "") + r, end="")
    print("]}")


def shown(full: list[str], short: bool):
    """Content as show prints it: tools, thoughts and errors cut to 200 characters unless asked for in full, the rest to 300 if all is to be short."""
    content, kind = F.col("content"), F.col("type")
    cut = F.when(kind.isin("tool", "thinking", "error") & ~kind.isin(*full), text.shorten(content, 200))
    return cut.otherwise(text.shorten(content, 300) if short else content)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session(a.master)
    spark.sparkContext.setLogLevel("ERROR")
    show = lambda df, **facts: emit(df, a.command if a.json else None, facts)
    types = tuple(x for x in getattr(a, "only", "").split(",") if x)
    limit = None if getattr(a, "all", False) or getattr(a, "n", None) in (0, None) else a.n
    options = Options(limit=limit, workspace=a.workspace, message_types=types)
    archive = open_backup(spark, a.b, options) if getattr(a, "b", None) else Archive(spark, a.data_path, options, parse_limits(a.source_limit))
    if a.command == "list":
        if a.ids:
            for r in archive.list_session_summaries().select("session_id").toLocalIterator():
                print(r["session_id"])
        elif a.workspaces:
            show(archive.list_workspaces())
        else:
            show(archive.list_session_summaries(), **(archive.pagination() if a.json else {}))
    elif a.command == "search":
        show(archive.search(a.query, a.c), query=a.query)
    elif a.command == "show":
        # on the command line indexes start at 1
        got = archive.get_session(int(a.session) - 1 if a.session.isdigit() else a.session)
        full = [k for k, on in (("thinking", a.think), ("tool", a.tool), ("error", a.error)) if on]
        show(got.withColumn("content", shown(full, a.short)))
    elif a.command == "export":
        (archive.export_markdown if a.f == "md" else archive.export_json)(a.o, int(a.session) - 1 if (a.session or "").isdigit() else a.session)
    elif a.command == "migrate":
        got = archive.migrate_workspace(a.source, a.target, dry_run=not a.o, copy=a.copy)
        got.write.parquet(a.o) if a.o else show(got)
    elif a.command == "migrate-session":
        got, state = archive.migrate_sessions(a.ids, a.to, dry_run=not a.o, copy=a.copy, expected=a.expect)
        got.write.parquet(a.o) if a.o else show(got, state=state)
        if not a.json:
            print(json.dumps({"state": state}))
    elif a.command == "backup":
        print(json.dumps(archive.backup(a.target, a.force)))
    elif a.command == "restore":
        print(restore_backup(spark, a.path, a.name, a.target).count())
    else:
        show(list_backups(spark, a.path))
    return 0


if __name__ == "__main__":
    sys.exit(main())
