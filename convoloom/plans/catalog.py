"""All registered queries of the core and their SQL."""

from __future__ import annotations

import importlib

from convoloom.plans import sql_exports, sql_merge, sql_messages, sql_problems, sql_sessions

#: Modules whose functions named qNN_ or pN_ are queries.
MODULES = (
    "operators.schema_drift",
    "operators.time_queries",
    "operators.nested",
    "operators.messages",
    "operators.listing",
    "operators.search",
    "operators.replicas",
    "operators.timeline",
    "operators.usage",
    "operators.workspaces",
    "operators.merge",
    "operators.export",
    "operators.snapshots",
    "operators.transcripts",
    "operators.kvstore",
    "operators.identity",
    "operators.claims",
    "streaming.windows",
)


def _collect() -> dict:
    out = {}
    for name in MODULES:
        module = importlib.import_module(f"convoloom.{name}")
        for k, f in vars(module).items():
            head = k.split("_", 1)[0]
            if callable(f) and head[:1] in "pq" and head[1:].isdigit() and f.__module__ == module.__name__:
                out[k] = f
    return dict(sorted(out.items(), key=lambda kv: (kv[0][0], int(kv[0].split("_")[0][1:]), kv[0])))


QUERIES = _collect()
SQL: dict[str, str] = {**sql_messages.SQL, **sql_sessions.SQL, **sql_merge.SQL, **sql_exports.SQL, **{k: v for k, v in sql_problems.SQL.items() if k in QUERIES}}
