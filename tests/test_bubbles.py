import json

from convoloom.functions.bubbles import bubble_text, read_bubbles, tool_call, tool_text
from convoloom.operators.identity import collision_free, tool_identities
from convoloom.operators.kvstore import rewrite_paths


def tool(name, params=None, result=None, **more):
    return {"name": name, **({"params": json.dumps(params)} if params is not None else {}), **({"result": result if isinstance(result, str) else json.dumps(result)} if result is not None else {}), **more}


def test_tool_texts():
    assert tool_text(tool("read_file", {"targetFile": "a.py"}, {"contents": "x"}, status="completed")) == "[Tool: Read File]\nFile: a.py\nContent: x\nStatus: ✓ completed"
    assert tool_text(tool("grep", {"query": "q", "path": "p"}, status="error")) == "[Tool: Grep]\nPattern: q\nPath: p\nStatus: ❌ error"
    assert tool_text(tool("run_terminal_cmd", {"command": "ls"}, {"output": "o"})) == "[Tool: Terminal Command]\nCommand: ls\nOutput: o"
    assert tool_text(tool("search_replace", {"file": "f", "oldString": "o" * 101, "newString": "n"})) == f"[Tool: Search & Replace]\nFile: f\nOld: {'o' * 100}...\nNew: n"
    assert tool_text(tool("custom", {"alpha": "1", "n": 2}, {"text": "t"})) == "[Tool: custom]\nAlpha: 1\nResult: t"
    assert tool_text(tool("custom", None, "plain")) == "[Tool: custom]\nResult: plain"
    assert tool_text(tool("edit_file_v2", {"path": "f", "content": {"a": 1}}, additionalData={"userDecision": "rejected"})) == '[Tool: Edit File v2]\nFile: f\nContent: {"a":1}\nUser Decision: ✗ rejected'
    assert tool_text(tool("read_file_v2", {"path": "f"}, {"diff": {"chunks": [{"diffString": "+a"}]}})) == "[Tool: Read File v2]\nFile: f\n```diff\n+a\n```"


def test_order_of_preference():
    diff = {"diff": {"chunks": [{"diffString": "+x"}]}, "resultForModel": "ok"}
    assert bubble_text({"toolFormerData": tool("write", {"relativeWorkspacePath": "a"}, diff, status="completed")}) == "[Tool: Write File]\nFile: a\n\n```diff\n+x\n```\n\nResult: ok\n\nStatus: ✓ completed"
    code = [{"content": "c\nd", "languageId": "py"}]
    assert bubble_text({"type": 2, "text": "t", "codeBlocks": code}) == "t\n\n```py\nc\nd\n```"
    assert bubble_text({"type": 1, "text": "t", "codeBlocks": code}) == "```py\nc\nd\n```"
    assert bubble_text({"type": 2, "text": json.dumps(diff)}) == "```diff\n+x\n```\n\nResult: ok"
    assert bubble_text({"type": 2, "thinking": {"text": "hm"}}) == "[Thinking]\nhm"
    assert bubble_text({"type": 1, "finalText": "f", "markdown": "m"}) == "f"
    assert bubble_text({"deep": [{"x": "short"}, {"y": "a\nlonger"}], "toolFormerData": {"additionalData": {"status": "error"}}}) == "[Error]\na\nlonger"
    assert bubble_text({}) == ""


def test_tool_calls():
    assert tool_call({"toolFormerData": tool("x", {"path": "p", "file": "f", "directory": "p"}, {"message": "m"}, status="error")}) == {"name": "x", "status": "error", "params": {"path": "p", "file": "f", "directory": "p"}, "files": ["f", "p"], "error": "m"}
    assert tool_call({"toolFormerData": tool("x", None, "r", rawArgs="{bad")}) == {"name": "x", "status": "completed", "params": {"_raw": "{bad"}, "result": "r"}
    assert tool_call({"toolFormerData": {"name": " "}}) is None and tool_call({"toolFormerData": 5}) is None


def test_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "{bad"), (3, "{}"), (4, '{"text":"x"}'), (5, "[]")], "k bigint, v string")
    assert [(r["k"], r["content"], r["corrupted"]) for r in read_bubbles(df, "k", "v").collect()] == [(1, "[corrupted message]", True), (2, "[corrupted message]", True), (3, "[empty message]", False), (4, "x", False), (5, "[corrupted message]", True)]


def test_identities():
    assert collision_free(["a", "a", "b", "a", "a:collision:1"], {"b"}) == ["a", "a:collision:1", "b:collision:1", "a:collision:2", "a:collision:1:collision:1"]
    ids = tool_identities("m", [{"name": "x"}, {"name": "x"}, {"name": "x", "params": {}}, {"id": "own", "name": "x"}])
    assert ids[0].endswith(":1") and ids[1].endswith(":2") and ids[0][:-2] == ids[1][:-2] != ids[2][:-2] and ids[3] == "own"


def test_paths_move():
    v = {"toolFormerData": {"params": json.dumps({"path": "/src/a", "targetFile": "/else"})}, "codeBlocks": [{"uri": {"path": "/src", "_formatted": "file:///src/b"}}, {"uri": 5}, None]}
    got, moved, kept = rewrite_paths(json.dumps(v), "/src/", "/dst")
    assert moved == 3 and kept == 1 and json.loads(json.loads(got)["toolFormerData"]["params"]) == {"path": "/dst/a", "targetFile": "/else"}
    assert json.loads(got)["codeBlocks"][0]["uri"] == {"path": "/dst", "_formatted": "file:///dst/b"}
