import json

import pytest

from tracemill.sources import dialects, transcripts


def read(spark, tmp_path, rows, dialect):
    (tmp_path / "f.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    out = dialects.DIALECTS[dialect](transcripts.read_lines(spark, str(tmp_path)))
    return [(r["type"], r["prompt"], r["action"], r["command"], r["path"], r["status"], r["exit_code"]) for r in out.orderBy("seq").collect()]


T = "2024-01-01T00:00:00Z"
item = lambda kind, **p: {"timestamp": T, "type": "response_item", "payload": {"type": kind, **p}}
said = lambda text: {"timestamp": T, "type": "event_msg", "payload": {"type": "user_message", "message": text}}


def test_rollout(spark, tmp_path):
    rows = [
        {"timestamp": T, "type": "session_meta", "payload": {"id": "s", "cwd": "/w"}},
        said("fix it"),
        item("function_call", name="shell", call_id="1", arguments=json.dumps({"command": ["bash", "-lc", "make test"]})),
        item("function_call_output", call_id="1", output=json.dumps({"output": "boom", "metadata": {"exit_code": 2, "duration_seconds": 1.5}})),
        said("taken back"),
        item("function_call", name="exec_command", call_id="2", arguments=json.dumps({"cmd": "ls"})),
        {"timestamp": T, "type": "event_msg", "payload": {"type": "thread_rolled_back", "num_turns": 1}},
        said("again"),
        item("function_call", name="exec_command", call_id="3", arguments=json.dumps({"cmd": "ls"})),
        item("function_call_output", call_id="3", output="Process exited with code 0\nWall time: 0.1"),
        "junk",
    ]
    assert read(spark, tmp_path, rows, "rollout") == [("prompt", "fix it", None, None, None, None, None), ("tool_call", None, "run", "make test", None, "failed", 2), ("prompt", "again", None, None, None, None, None), ("tool_call", None, "search", "ls", None, "succeeded", None)]


def test_replay(spark, tmp_path):
    call = lambda i, status: {"id": i, "name": "replace", "args": {"file_path": "/w/a.py"}, "status": status}
    rows = [
        {"sessionId": "s", "cwd": "/w"},
        {"id": "a", "type": "user", "content": "old", "timestamp": T},
        {"id": "a", "type": "user", "content": "new", "timestamp": T},
        {"id": "b", "type": "gemini", "toolCalls": [call("1", "error")], "timestamp": T},
        {"$rewindTo": "b"},
        {"id": "c", "type": "gemini", "toolCalls": [call("2", "success"), call("3", "cancelled")], "timestamp": T},
    ]
    assert read(spark, tmp_path, rows, "replay") == [("prompt", "new", None, None, None, None, None), ("tool_call", None, "edit", None, "a.py", "succeeded", None), ("tool_call", None, "edit", None, "a.py", "interrupted", None)]


def test_chain(spark, tmp_path):
    rec = lambda u, p, kind, *parts: {"uuid": u, "parentUuid": p, "sessionId": "s", "cwd": "/w", "timestamp": T, "type": kind, "message": {"parts": list(parts)}}
    rows = [
        rec("1", None, "user", {"text": "go"}),
        rec("2", "1", "assistant", {"functionCall": {"id": "x", "name": "run_shell_command", "args": {"command": "ls"}}}),
        rec("3", "1", "assistant", {"functionCall": {"id": "y", "name": "run_shell_command", "args": {"command": "pwd"}}}),
        rec("4", "3", "user", {"functionResponse": {"id": "y", "response": {"error": "exit code 3"}}}),
    ]
    assert read(spark, tmp_path, rows, "chain") == [("prompt", "go", None, None, None, None, None), ("tool_call", None, "run", "pwd", None, "failed", 3)]


def test_typed_events(spark, tmp_path):
    e = lambda kind, **d: {"type": kind, "timestamp": T, "data": d}
    rows = [
        e("session.start", sessionId="s", context={"cwd": "/w"}),
        e("user.message", content="go"),
        e("tool.execution_start", toolCallId="1", toolName="bash", arguments={"command": "make"}),
        e("tool.execution_complete", toolCallId="1", success=True, result={"content": "x\n<exited with exit code 1>"}),
        e("tool.execution_start", toolCallId="2", toolName="view", arguments={"path": "/w/b"}),
    ]
    assert read(spark, tmp_path, rows, "typed_events") == [("prompt", "go", None, None, None, None, None), ("tool_call", None, "run", "make", None, "failed", 1), ("tool_call", None, "read", None, "b", "interrupted", None)]


def test_headed_messages(spark, tmp_path):
    m = lambda role, *content, **more: {"type": "message", "timestamp": T, "message": {"role": role, "content": list(content)}, **more}
    rows = [
        {"type": "session_start", "id": "s", "cwd": "/w"},
        m("user", {"type": "text", "text": "go"}),
        m("user", {"type": "text", "text": "hidden"}, visibility="llm_only"),
        m("assistant", {"type": "tool_use", "id": "1", "name": "Execute", "input": {"command": "make"}}),
        m("user", {"type": "tool_result", "tool_use_id": "1", "content": "all good\nexit code: 0"}),
    ]
    assert read(spark, tmp_path, rows, "headed_messages") == [("prompt", "go", None, None, None, None, None), ("tool_call", None, "run", "make", None, "succeeded", None)]
