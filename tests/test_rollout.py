"""Rollout logs in detail: forks, rollbacks, polls, patches; split records; summaries of prompts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.sources import dialects, rollout, split, transcripts

T = "2024-01-01T00:00:00Z"


def item(kind, **p):
    return {"timestamp": T, "type": "response_item", "payload": {"type": kind, **p}}


def event(kind, **p):
    return {"timestamp": T, "type": "event_msg", "payload": {"type": kind, **p}}


def meta(name, **p):
    return {"timestamp": T, "type": "session_meta", "payload": {"id": name, "cwd": "/w", **p}}


def turn(name):
    return {"timestamp": T, "type": "turn_context", "payload": {"turn_id": name}}


def say(words):
    return event("user_message", message=words)


def run(n, command, **more):
    return item("function_call", name="exec_command", call_id=n, arguments=json.dumps({"cmd": command, **more}))


def poll(n, process):
    return item("function_call", name="write_stdin", call_id=n, arguments=json.dumps({"session_id": process}))


def out(n, *head, said=None):
    return item("function_call_output", call_id=n, output="\n".join([*head, *([] if said is None else ["Output:", said])]))


def back(n):
    return event("thread_rolled_back", num_turns=n)


def lines(spark, *files):
    rows = [(f"f{n}", i, r if isinstance(r, str) else json.dumps(r)) for n, f in enumerate(files) for i, r in enumerate(f)]
    return spark.createDataFrame(rows, "file string, line int, value string").repartition(3)


def read(spark, *files):
    return dialects.rollout(lines(spark, *files)).orderBy("session", "seq").collect()


def prompts(spark, *files):
    return [r["prompt"] for r in read(spark, *files) if r["type"] == "prompt"]


def test_forks_and_subagents(spark):
    fork = [meta("b"), say("before"), meta("a"), turn("a1"), say("copied"), turn("a9"), say("copied too"), turn("b1"), say("own"), meta("b"), turn("a0"), say("older again"), turn("c"), say("own too")]
    assert prompts(spark, fork) == ["before", "own", "own too"]
    assert prompts(spark, [meta("b"), turn("a"), say("no fork")]) == ["no fork"]
    for source in ({"source": {"subagent": "review"}}, {"source": {"internal": None}}, {"thread_source": "subagent"}):
        assert prompts(spark, [meta("x", **source), say("hidden")]) == []
    assert prompts(spark, [meta("x", source="cli"), meta("x", thread_source="subagent"), say("shown")]) == ["shown"]


def test_rollbacks_equal_a_stack(spark):
    rng = random.Random(2)
    files, want = [], []
    for n in range(40):
        rows, stack = [meta(f"s{n:02}"), "no json"], []
        for i in range(rng.randint(1, 25)):
            if rng.random() < 0.6:
                rows.append(say(f"p{i}"))
                stack.append([f"p{i}"])
            elif rng.random() < 0.5:
                k = rng.randint(0, 3)
                rows.append(back(k))
                if k:
                    del stack[max(0, len(stack) - k) :]
            else:
                rows.append(run(f"c{i}", f"make {i}"))
                if stack:
                    stack[-1].append(f"make {i}")
                else:
                    want.append((f"s{n:02}", f"make {i}"))
        files.append(rows)
        want += [(f"s{n:02}", x) for turn_ in stack for x in turn_]
    got = [(r["session"], r["prompt"] or r["command"]) for r in read(spark, *files)]
    assert sorted(got) == sorted(want)


def test_polls_are_stitched(spark):
    log = [
        meta("s"), say("go"), run("1", "make all"), out("1", "Wall time: 1.5 seconds", "Process running with session ID 7", said="one\n"),
        run("2", "make b"), poll("3", 7), out("3", "Wall time: 2 seconds", "Process running with session ID 7", said="two\n"), out("2", "Process exited with code 0", "Wall time: 0.25 seconds", said="fine"),
        poll("4", "7"), out("4", "no header"), poll("5", 7), out("5", "Wall time: 0.5 seconds", "Process exited with code 2", said="error: three"), poll("6", 7), out("6", "Process exited with code 0", said="late"),
        run("7", "make c"), out("7", "Process running with session ID 8", said=""), run("8", "make d"), out("8", "Process running with session ID 9", said="x"), poll("9", 9), out("9", "Chunk ID: 1", said="aborted by user"),
        run("10", "make e"), out("10", "Process running with session ID 7", said=""), poll("11", 7), out("11", "Exit code: 0", said="again"),
    ]
    got = {r["command"]: (r["status"], r["exit_code"], r["duration_ms"], r["error"]) for r in read(spark, log) if r["type"] == "tool_call"}
    assert got == {"make all": ("failed", 2, 4000, "error: three"), "make b": ("succeeded", None, 250, None), "make c": ("interrupted", None, None, None), "make d": ("interrupted", None, None, None), "make e": ("succeeded", None, None, None)}


def test_outputs(spark):
    old = json.dumps({"output": "bad", "metadata": {"exit_code": 3, "duration_seconds": 0.5}})
    log = [meta("s"), say("go"), *(x for n, o in enumerate([old, "Exit code: 0\nWall time: x\nOutput:\nok", "Output:\nnothing", "plain words", "rejected by user"]) for x in (run(str(n), f"make {n}"), item("function_call_output", call_id=str(n), output=o)))]
    log += [item("function_call", name="view_image", call_id="v", arguments='{"path": "/w/a.png"}'), item("function_call_output", call_id="v", output=[{"text": "seen"}, {"text": "it"}]), item("function_call", name="update_plan", call_id="u", arguments="{}")]
    log += [item("web_search_call", action={"query": "how"}), item("web_search_call", status="failed", action={"url": "http://x"}), item("local_shell_call", id="l", action={"command": ["bash", "-lc", "ls a"], "working_directory": "sub dir"}), item("function_call_output", call_id="l", output="Exit code: 0")]
    log += [run("w", "make w", workdir="/w/pkg"), run("o", "make o", workdir="/elsewhere"), run("p", "make t | tail -1"), item("function_call_output", call_id="p", output="Exit code: 0\nOutput:\n1 failed")]
    got = [(r["action"], r["command"] or r["path"] or r["query"], r["status"], r["exit_code"]) for r in read(spark, log) if r["type"] == "tool_call"]
    assert got == [
        ("run", "make 0", "failed", 3), ("run", "make 1", "succeeded", None), ("run", "make 2", "failed", None), ("run", "make 3", "failed", None), ("run", "make 4", "interrupted", None), ("read", "a.png", "succeeded", None),
        ("fetch", "how", "succeeded", None), ("fetch", "http://x", "interrupted", None), ("search", "cd 'sub dir' && ls a", "succeeded", None), ("run", "cd pkg && make w", "interrupted", None), ("run", "make o", "interrupted", None), ("run", "make t | tail -1", "failed", None),
    ]


PATCH = "*** Begin Patch\n*** Update File: src/a.py\n@@\n-x\n+def f():\n*** End Patch"


def test_patches_say_what_they_did(spark):
    call = lambda n: item("custom_tool_call", name="apply_patch", call_id=n, input=PATCH)
    done = lambda n: item("custom_tool_call_output", call_id=n, output="Exit code: 0")
    end = lambda n, **p: event("patch_apply_end", call_id=n, **p)
    files = {"/w/new.py": {"type": "add", "content": "def g():\n    pass\n"}, "/w/gone.py": {"type": "delete", "content": "a\nb\n"}, "/w/b.py": {"type": "update", "unified_diff": "@@ -1 +1 @@\n-x\n+y", "move_path": "/w/c.py"}, "/w/odd": {"type": "other"}}
    log = [meta("s"), say("go"), call("1"), end("1", changes=files, success=True), done("1"), call("2"), end("2", changes=files, status="declined"), done("2"), call("3"), end("3", changes={}, success=False), done("3"), call("4"), done("4"), end("4", changes=files), run("5", f"apply_patch <<'E'\n{PATCH}\nE"), out("5", "Exit code: 0")]
    got = [(r["status"], [(c["path"], c["created"], c["lines_added"], c["lines_removed"], c["symbols"]) for c in r["changes"]]) for r in read(spark, log) if r["type"] == "tool_call"]
    asked = [("src/a.py", False, 1, 1, ["f"])]
    assert got == [("succeeded", [("c.py", False, 1, 1, []), ("gone.py", False, 0, 2, []), ("new.py", True, 2, 0, ["g"])]), ("interrupted", []), ("failed", []), ("succeeded", asked), ("succeeded", asked)]


def test_headers(spark):
    given = {"Exit code: 1\nOutput:\nx\ny": (1, None, None, "x\ny"), "Wall time: 1.5 seconds\nbody": (None, None, 1500, ""), "Output:\nx": (None, None, None, None), "": (None, None, None, None), "Exit code: 1\nExit code: 2": (2, None, None, ""), "Process running with session ID 12 \nOutput: \nq": (None, "12", None, "q"), "Exit code: x\nOutput:": (None, None, None, "")}
    df = spark.createDataFrame([(k,) for k in given], "t string").select("t", rollout.header(F.col("t")).alias("h"))
    assert {r["t"]: tuple(r["h"]) for r in df.collect()} == given


def test_split_records(spark):
    """Records cut at random line ends within their strings read as whole ones; what can't be mended costs only itself."""
    rng = random.Random(7)
    text_, want = [], []
    for n in range(300):
        body = "\n".join(f"line {rng.randint(0, 9)}" + rng.choice(["", " {", ' "']) for _ in range(rng.choice([1, 1, 2, 5, 30])))
        record = json.dumps({"type": "t", "n": n, "body": body})
        cut = rng.random() < 0.5
        text_ += (record.replace("\\n", "\n") if cut else record).split("\n")
        want.append((n, body))
        if rng.random() < 0.1:
            text_ += rng.choice([["junk"], ['{"type": "t", "n": broken'], ["{ not json"]])
    text_ += ['{"type": "t", "body": "' + "x", *["y"] * 70, '"}', '{"type": "t", "n": 300, "body": "last"}']
    want.append((300, "last"))
    plain = [json.loads(r) for _, r in split.joined(list(enumerate(text_)))]
    assert [(r["n"], r["body"]) for r in plain] == want
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(text_)], "file string, line int, value string").repartition(4)
    got = [json.loads(r["value"]) for r in split.rejoined(df).orderBy("line").collect()]
    assert got == plain


def plain_summary(prompt, dialect):
    """A prompt's summary line by line."""
    skipped, pasted_tag = fixed.PROMPTS[dialect]
    prompt = prompt.strip()
    if not prompt or prompt.startswith(skipped):
        return None
    tags = [t.rstrip(">") for t in (*skipped, *([pasted_tag] if pasted_tag else [])) if t.startswith("<")]
    after = lambda t: t[t.index(">") + 1 :].strip() if ">" in t else ""
    wrapper, pasted, found = None, None, None
    for line in prompt.split("\n"):
        rest = line.strip()
        while rest and found is None:
            if wrapper:
                close = rest.find("</" + wrapper[1:])
                inside = (rest if close < 0 else rest[:close]).strip()
                if wrapper == pasted_tag and inside and pasted is None:
                    pasted = inside
                if close < 0:
                    break
                wrapper, rest = None, after(rest[close:])
            elif tag := next((t for t in tags if rest.startswith(t)), None):
                wrapper, rest = tag, after(rest)
            else:
                found = rest
        if found is not None:
            break
    line = found if found is not None else (pasted or "")
    if len(line) > 200:
        cut, at = 200, line.rfind(fixed.REDACTED, 0, 200 + len(fixed.REDACTED) - 1)
        if at >= 0 and not (0 <= line.find("]", at) < 200):
            cut = at
        line = line[:cut]
    return line.rstrip() or None


@pytest.mark.parametrize("dialect", sorted(fixed.PROMPTS))
def test_summaries_equal_plain_python(spark, dialect):
    rng = random.Random(3)
    some = ["<system-reminder>", "</system-reminder>", "<pasted_content id=1>", "<pasted_content", "</pasted_content>", "<environment_context>", "</environment_context>", "<state_snapshot>", "</state_snapshot>", "fix it", " ", "\n", "\n\n", "a > b", "Caveat: x", "é <b>", "[REDACTED:token]", "/help", "x" * 90]
    given = sorted({"".join(rng.choice(some) for _ in range(rng.randint(0, 9))) for _ in range(400)} | {"y" * 195 + "[REDACTED:a] z", "y" * 188 + "[REDACTED:a] z", "y" * 199 + "[REDACTED:a] z", "y" * 500})
    df = spark.createDataFrame([(t,) for t in given] + [(None,)], "t string").select("t", text.summary(F.col("t"), dialect).alias("s"))
    wrong = [(r["t"], r["s"], plain_summary(r["t"], dialect)) for r in df.collect() if r["t"] is not None and r["s"] != plain_summary(r["t"], dialect)]
    assert not wrong, wrong[:3]


def test_long_prompts_are_cut_at_a_word(spark):
    long = "word " * 20000
    got = spark.createDataFrame([(long,), ("z" * 70000,)], "t string").select(text.summary(F.col("t"), "rollout").alias("s")).collect()
    assert got[0]["s"] == long[:200].rstrip() and got[1]["s"] is None


def test_canonical_columns(spark):
    assert tuple(dialects.rollout(lines(spark, [meta("s")])).columns) == transcripts.EVENT
