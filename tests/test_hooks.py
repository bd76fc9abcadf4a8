"""Payloads of every dialect, and edits in session logs."""

import json

from tracemill.sources import hooks, transcripts
from tracemill.sources.dialects import DIALECTS

OWN = {"session_id": "s", "cwd": "/w"}
PAYLOADS = [
    ("session_log", {"hook_event_name": "UserPromptSubmit", "prompt": "do", **OWN}, ("prompt", "do", False)),
    ("session_log", {"hook_event_name": "UserPromptSubmit", "prompt": "do", "cursor_version": "1", **OWN}, None),
    ("session_log", {"hook_event_name": "PostToolUseFailure", "tool_name": "Bash", "error": "bad", **OWN}, ("failed", "bad", False)),
    ("session_log", {"hook_event_name": "PostToolUseFailure", "tool_name": "Read", "error": "bad", **OWN}, None),
    ("session_log", {"hook_event_name": "SessionEnd", "session_id": "s", "cwd": "w"}, None),
    ("rollout", {"hook_event_name": "UserPromptSubmit", "prompt": "do", "agent_id": "a", **OWN}, None),
    ("rollout", {"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_response": "x\nProcess exited with code 2", **OWN}, ("failed", "x\nProcess exited with code 2", False)),
    ("rollout", {"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_response": "x\nProcess exited with code 0", **OWN}, None),
    ("replay", {"hook_event_name": "BeforeAgent", "prompt": "do", **OWN}, ("prompt", "do", False)),
    ("replay", {"hook_event_name": "AfterAgent", "stop_hook_active": True, **OWN}, ("turn end", None, True)),
    ("chain", {"hook_event_name": "UserPromptSubmit", "prompt": "context do", "submitted_prompt": "do", **OWN}, ("prompt", "do", False)),
    ("headed_messages", {"hook_event_name": "PostToolUse", "tool_name": "Execute", "tool_response": {"exitCode": 1, "stdout": "a", "stderr": "b"}, **OWN}, ("failed", "a\nb", False)),
    ("headed_messages", {"hook_event_name": "PostToolUse", "tool_name": "Execute", "tool_response": {"is_error": True, "interrupted": True, "stdout": "a"}, **OWN}, None),
    ("typed_events", {"sessionId": "s", "cwd": "/w", "prompt": "do"}, ("prompt", "do", False)),
    ("typed_events", {"sessionId": "s", "cwd": "/w", "toolName": "bash", "toolResult": {"resultType": "failure", "textResultForLlm": "no"}}, ("failed", "no", False)),
    ("typed_events", {"sessionId": "s", "cwd": "/w", "toolName": "bash", "error": {"message": "The user denied it: user denied"}}, None),
    ("typed_events", {"sessionId": "s", "cwd": "/w", "stopReason": "end"}, ("turn end", None, False)),
    ("journal", {"hook_event_name": "stop", "conversation_id": "s", "workspace_roots": ["/w"], "loop_count": 1}, ("turn end", None, True)),
    ("journal", {"hook_event_name": "beforeSubmitPrompt", "conversation_id": "s", "workspace_roots": ["/w"], "prompt": "  "}, None),
]


def test_moments(spark):
    rows = [(d, json.dumps({**p, "transcript_path": str(n)} if d != "typed_events" else {**p, "transcriptPath": str(n)})) for n, (d, p, _) in enumerate(PAYLOADS)] + [("session_log", "no json"), ("session_log", None), ("other", "{}")]
    got = {int(r["transcript"]): (r["moment"], r["text"], r["continued"]) for r in hooks.moments(spark.createDataFrame(rows, "dialect string, payload string")).collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(PAYLOADS) if want}


def test_edits_in_logs(spark):
    top = {"sessionId": "s", "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z"}
    use = lambda key, name, **given: {"type": "assistant", **top, "message": {"content": [{"type": "tool_use", "id": key, "name": name, "input": given}]}}
    done = lambda key, bad=False: {"type": "user", **top, "message": {"content": [{"type": "tool_result", "tool_use_id": key, "content": "x", "is_error": bad}]}}
    log = [use("1", "Edit", file_path="/w/a.py", old_string="def f():\n  a", new_string="def f():\n  b\n  c"), done("1"), use("2", "Write", file_path="/w/b.py", content="class B:\n  pass\n"), done("2"), use("3", "Edit", file_path="/w/c.py", old_string="a", new_string="b"), done("3", True), use("4", "Bash", command="ls"), done("4")]
    lines = spark.createDataFrame([("f", n, json.dumps(x)) for n, x in enumerate(log)], "file string, line int, value string")
    got = [[tuple(c) for c in r["changes"]] for r in transcripts.session_log(lines).orderBy("seq").collect()]
    assert got == [[("a.py", False, [], 2, 1)], [("b.py", True, ["B"], 2, 0)], [], []]

    patch = "*** Begin Patch\n*** Add File: n.py\n+def g():\n+  x\n*** Update File: o.py\n@@ def h():\n-a\n+b\n*** End Patch"
    top = lambda kind, **payload: {"timestamp": "2024-01-01T00:00:00Z", "type": kind, "payload": payload}
    log = [top("session_meta", id="s", cwd="/w"), top("response_item", type="custom_tool_call", name="apply_patch", call_id="1", arguments=json.dumps({"input": patch})), top("response_item", type="custom_tool_call_output", call_id="1", output="Exit code: 0")]
    lines = spark.createDataFrame([("f", n, json.dumps(x)) for n, x in enumerate(log)], "file string, line int, value string")
    got = [tuple(c) for c in DIALECTS["rollout"](lines).first()["changes"]]
    assert got == [("n.py", True, ["g"], 2, 0), ("o.py", False, ["h"], 1, 1)]
