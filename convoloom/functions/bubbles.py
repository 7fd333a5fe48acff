"""Readable text of stored message values: tool calls, diffs, code, thoughts, in a fixed order of preference.

Tools are described by data: a title, the labelled lines with the parameter names each may come from, and what of the
result is shown. One renderer reads the descriptions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

FILE_KEYS = ("targetFile", "path", "file")


@dataclass(frozen=True)
class Tool:
    title: str
    lines: tuple[tuple[str, tuple[str, ...]], ...] = ()
    result: tuple[tuple[str, str], ...] = ()  # (label, member of the result)
    cut: int = 0  # characters of a parameter that are shown, 0 for all


_SEARCH = (("Pattern", ("pattern", "query", "searchQuery", "regex")), ("Path", ("path", "directory", "targetDirectory")))
_EDIT = (("File", (*FILE_KEYS, "filePath", "relativeWorkspacePath")), ("Old", ("oldString", "old_string", "search", "searchString")), ("New", ("newString", "new_string", "replace", "replaceString")))
_WRITE = (("File", (*FILE_KEYS, "relativeWorkspacePath")),)
_RUN = (("Command", ("command", "cmd")),)
# Names of tools and what is shown of them.
TOOLS = {
    "read_file": Tool("Read File", (("File", FILE_KEYS),), (("Content", "contents"),)),
    "list_dir": Tool("List Directory", (("Directory", ("targetDirectory", "path", "directory")),)),
    "grep": Tool("Grep", _SEARCH),
    "search": Tool("Search", _SEARCH),
    "codebase_search": Tool("Search", _SEARCH),
    "run_terminal_command": Tool("Terminal Command", _RUN, (("Output", "output"),)),
    "run_terminal_cmd": Tool("Terminal Command", _RUN, (("Output", "output"),)),
    "execute_command": Tool("Terminal Command", _RUN, (("Output", "output"),)),
    "edit_file": Tool("Edit File", _EDIT, cut=100),
    "search_replace": Tool("Search & Replace", _EDIT, cut=100),
    "create_file": Tool("Create File", _WRITE),
    "write_file": Tool("Write File", _WRITE),
    "write": Tool("Write File", _WRITE),
}
V2 = {"read_file_v2": ("Read File v2", (*FILE_KEYS, "effectiveUri")), "edit_file_v2": ("Edit File v2", (*FILE_KEYS, "relativeWorkspacePath"))}
TEXT_FIELDS = ("text", "content", "finalText", "message", "markdown", "textDescription")
DECISIONS = {"accepted": "✓", "rejected": "✗"}


def filled(v) -> bool:
    return isinstance(v, str) and v.strip() != ""


def parsed(text):
    """The value of a JSON text, None if it isn't JSON."""
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None


def member(v, *names):
    for n in names:
        v = v.get(n) if isinstance(v, dict) else None
    return v


def tool_params(tool: dict) -> dict | None:
    """Parameters as an object; a text that isn't one under _raw; None for none."""
    raw = tool.get("params") if tool.get("params") is not None else tool.get("rawArgs")
    if not filled(raw):
        return None
    v = parsed(raw)
    return v if isinstance(v, dict) else {"_raw": raw}


def first_param(params: dict | None, names) -> str:
    return next((params[n] for n in names if filled(params.get(n))), "") if params else ""


def first_text(*candidates) -> str | None:
    """The first filled text, else the first other value as JSON."""
    for c in candidates:
        if filled(c):
            return c
    rest = [c for c in candidates if c is not None and not isinstance(c, str)]
    return json.dumps(rest[0], ensure_ascii=False, separators=(",", ":")) if rest else None


def diff_text(diff) -> str | None:
    chunks = member(diff, "chunks")
    parts = [f"```diff\n{c['diffString']}\n```" for c in chunks if filled(member(c, "diffString"))] if isinstance(chunks, list) else []
    return "\n".join(parts) or None


def closing(tool: dict) -> list[str]:
    """Status and the user's decision."""
    out = []
    if tool.get("status"):
        out.append(f"Status: {'✓' if tool['status'] == 'completed' else '❌'} {tool['status']}")
    decision = member(tool, "additionalData", "userDecision")
    if filled(decision):
        out.append(f"User Decision: {DECISIONS.get(decision, '⏳')} {decision}")
    return out


def tool_text(tool: dict, code: list | None = None) -> str:
    """A tool call as text."""
    name, params = tool.get("name") or "unknown", tool_params(tool) or {}
    result, first_code = parsed(tool.get("result") or "{}"), member(code[0], "content") if code else None
    out: list[str] = []

    def line(label, value, cut=0):
        if value:
            out.append(f"{label}: {value[:cut] + '...' if cut and len(value) > cut else value}")

    if name in V2:
        title, keys = V2[name]
        out.append(f"[Tool: {title}]")
        line("File", first_param(params, keys))
        own = [member(result, "contents"), first_code] if name == "read_file_v2" else [params.get("streamingContent"), first_code, params.get("content"), params.get("fileContent")]
        body = first_text(*own)
        line("Content", body)
        diff = diff_text(member(result, "diff")) if name == "read_file_v2" else None
        if diff:
            out += ([""] if body else []) + [diff]
    elif name in TOOLS:
        spec = TOOLS[name]
        out.append(f"[Tool: {spec.title}]")
        for label, keys in spec.lines:
            line(label, first_param(params, keys), spec.cut if label in ("Old", "New") else 0)
        for label, key in spec.result:
            shown = member(result, key)
            if filled(shown) or (label == "Content" and shown):
                line(label, str(shown))
    else:
        out.append(f"[Tool: {name}]")
        for k, v in params.items():
            if filled(v):
                line(k[:1].upper() + k[1:], v)
        if result is None:
            line("Result", tool["result"] if len(tool["result"]) < 1000 else "")
        else:
            shown = next((member(result, k) for k in ("output", "result", "content", "text") if member(result, k)), None)
            line("Result", shown if filled(shown) else "")
    return "\n".join(out + closing(tool))


def changed_file_text(tool: dict) -> str | None:
    """A tool call whose result holds a diff, as text; None for others."""
    result = parsed(tool.get("result") or "")
    if not isinstance(member(result, "diff"), dict):
        return None
    out = [f"[Tool: {'Write File' if (tool.get('name') or 'write') in ('write', 'write_file') else 'Edit File'}]"]
    path = first_param(tool_params(tool), ("relativeWorkspacePath", "file_path"))
    out += [f"File: {path}"] if path else []
    diff = diff_text(result["diff"])
    out += ["", diff] if diff else []
    out += ["", f"Result: {result['resultForModel']}"] if filled(result.get("resultForModel")) else []
    end = closing(tool)
    return "\n".join(out + ([""] if tool.get("status") else []) + end)


def code_parts(data: dict) -> list[str]:
    blocks = data.get("codeBlocks")
    if not isinstance(blocks, list):
        return []
    got = [(member(b, "languageId") or "", member(b, "content")) for b in blocks]
    return [f"```{lang}\n{c}\n```" if lang else c for lang, c in got if filled(c)]


def longest_marked(v, best: str = "") -> str:
    """The longest text anywhere inside that has line breaks, fences or headings."""
    stack = [v]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, str) and len(x) > len(best) and ("\n" in x or "```" in x or "# " in x):
            best = x
    return best


def bubble_text(data: dict) -> str:
    """The text of a stored message."""
    tool = data.get("toolFormerData") if isinstance(data.get("toolFormerData"), dict) else {}
    code, name = code_parts(data), tool.get("name")
    if tool.get("result") and name != "read_file_v2" and (text := changed_file_text(tool)):
        return text
    if name:
        blocks = data.get("codeBlocks") if isinstance(data.get("codeBlocks"), list) else []
        text, shown = tool_text(tool, blocks), member(blocks[0], "content") if blocks else None
        if name not in V2 and isinstance(shown, str):
            text += "\nContent: " + shown[:200].replace("\n", "\\n") + ("..." if len(shown) > 200 else "")
        return text
    thought = member(data, "thinking", "text")
    thought = f"[Thinking]\n{thought}" if filled(thought) else None
    if data.get("type") == 2:
        own = data.get("text")
        if filled(own):
            value = parsed(own) if own.strip().startswith("{") else None
            diff = diff_text(member(value, "diff"))
            if diff:
                return diff + (f"\n\nResult: {value['resultForModel']}" if value.get("resultForModel") else "")
            return "\n\n".join([own, *code])
        if thought:
            return "\n\n".join([thought, *code])
        if tool.get("result"):
            value = parsed(tool["result"])
            shown = next((value[k] for k in ("contents", "content", "text") if filled(member(value, k))), None)
            if shown or value is None and len(tool["result"]) > 50 and not tool["result"].startswith("{"):
                return shown or tool["result"]
    if code:
        return "\n\n".join(code)
    own = next((data[k] for k in TEXT_FIELDS if filled(data.get(k))), None)
    if own or thought:
        return own or thought
    best = longest_marked(data)
    return f"[Error]\n{best}" if best and member(tool, "additionalData", "status") == "error" else best


def tool_status(tool: dict) -> str:
    both = (member(tool, "additionalData", "status"), tool.get("status"))
    return next((s for s in ("error", "cancelled") if s in both), "completed")


def tool_call(data: dict) -> dict | None:
    """name, status, params, files, result or error of a stored message's tool call."""
    tool = data.get("toolFormerData") if isinstance(data.get("toolFormerData"), dict) else {}
    name = (tool.get("name") or "").strip() if isinstance(tool.get("name"), str) else ""
    if not name:
        return None
    params, status = tool_params(tool), tool_status(tool)
    out = {"name": name, "status": status}
    if params:
        out["params"] = params
    groups = (("targetFile", "file", "filePath", "relativeWorkspacePath"), ("path",), ("targetDirectory", "directory"))
    files = list(dict.fromkeys(f for f in (first_param(params, g) for g in groups) if f))
    if files:
        out["files"] = files
    result = tool.get("result")
    if filled(result) and status == "error":
        out["error"] = next((v for k in ("error", "message", "stderr", "output", "resultForModel") if filled(v := member(parsed(result), k))), result)
    elif filled(result) and status == "completed":
        out["result"] = result
    return out


def read_bubbles(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, content, tool (JSON or null), corrupted: null values and values that aren't JSON objects are [corrupted message], no text at all is [empty message]."""

    def one(raw):
        data = parsed(raw)
        if not isinstance(data, dict):
            return "[corrupted message]", None, True
        call = tool_call(data)
        return bubble_text(data) or "[empty message]", json.dumps(call, ensure_ascii=False) if call else None, False

    def go(batches):
        for b in batches:
            rows = [one(v) for v in b.column(1).to_pylist()]
            clean = lambda s: s if s is None else s.encode("utf8", "replace").decode()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean(r[0]) for r in rows], pa.string()), pa.array([clean(r[1]) for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=[key, "content", "tool", "corrupted"])

    return df.select(key, value).mapInArrow(go, f"{key} {dict(df.dtypes)[key]}, content string, tool string, corrupted boolean")
