"""Rollout logs: {timestamp, type, payload} lines of one session a file.

A fork's copied history, turns rolled back and whole subagent files are left out by windows over a file's lines. Shell calls that go on running are
stitched to the answers of later polls by their process, so that one call has one output, its time added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import patches, shell, text
from tracemill.functions.redaction import let
from tracemill.sources.transcripts import CHANGES, _string, assemble, carried, change_of, parsed, relative

# Tools that run commands, tools that are bookkeeping, what the others do, shells and flags of a script, and lines of an output's header.
SHELLS = ("exec_command", "shell_command", "shell", "local_shell")
BOOKKEEPING = ("update_plan", "request_user_input", "request_permissions", "wait", "wait_agent", "send_input", "resume_agent", "close_agent", "list_agents", "create_goal", "get_goal", "update_goal")
ACTIONS = {"apply_patch": "edit", "view_image": "read", "spawn_agent": "delegate", "web_search": "fetch"}
SCRIPT_SHELLS, SCRIPT_FLAGS = ("bash", "sh", "zsh", "/bin/bash", "/bin/sh", "/bin/zsh"), ("-c", "-lc")
HEADER = r"Process exited with code |Exit code: |Process running with session ID |Wall time: |Chunk ID: |Original token count: |Total output lines: "
STOPPED = "aborted by user|rejected by user"


def _p(path: str, j: str = "j") -> Column:
    return _string(F.col(j), f"$.payload.{path}")


def _has(path: str) -> Column:
    return F.try_variant_get("j", f"$.payload.{path}", "variant").isNotNull()


def effective(lines: DataFrame) -> DataFrame:
    """The lines of a file that are its own: (file, line, j, top, kind, own), own being the session's id.

    A second session_meta with another id begins a copy of the parent's history, which ends with the first turn whose id isn't smaller than the
    file's own. A rollback takes back that many turns of those that are left. Files of subagents go.
    """
    j = parsed(lines).withColumn("top", _string(F.col("j"), "$.type")).where("top IS NOT NULL").withColumn("kind", _p("type"))
    order = Window.partitionBy("file").orderBy("line")
    so_far, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    meta, name = F.col("top") == "session_meta", _p("id")
    sub = _has("source.subagent") | _has("source.internal") | F.coalesce(_p("thread_source").isin("subagent", "memory_consolidation"), F.lit(False))
    j = j.withColumn("own", F.first(F.when(meta, name), True).over(every)).withColumn("__sub", F.first(F.when(meta, sub), True).over(every)).where("NOT coalesce(__sub, false)")
    foreign = F.coalesce(meta & (name != F.col("own")), F.lit(False))
    again = F.coalesce(meta, F.lit(False)) & (F.count(F.when(meta & name.isNotNull(), 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0)
    j = j.withColumn("__forked", F.max(foreign).over(so_far)).withColumn("__again", again | foreign)
    starts = (F.col("top") == "turn_context") | ((F.col("top") == "event_msg") & (F.col("kind") == "task_started"))
    turn = F.when(starts & F.col("__forked"), _p("turn_id"))
    copied = F.last(F.when(foreign, F.lit(True)).when(turn.isNotNull(), turn < F.col("own")), True).over(so_far)
    j = j.withColumn("__copied", F.coalesce(copied, F.lit(False))).where("NOT __again AND NOT __copied")
    said = (F.col("top") == "event_msg") & (F.col("kind") == "user_message")
    back = F.when((F.col("top") == "event_msg") & (F.col("kind") == "thread_rolled_back"), F.greatest(F.coalesce(F.try_variant_get("j", "$.payload.num_turns", "int"), F.lit(0)), F.lit(0)))
    # turns that are left: a running sum that is held at zero
    j = j.withColumn("__x", F.when(back.isNotNull(), -back).otherwise(F.coalesce(said, F.lit(False)).cast("int"))).withColumn("__back", back)
    j = j.withColumn("__s", F.sum("__x").over(so_far)).withColumn("__depth", F.col("__s") - F.least(F.lit(0), F.min("__s").over(so_far)))
    later = F.min(F.when(F.col("__back") > 0, F.col("__depth"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    j = j.withColumn("__later", later).where("__back IS NULL AND (__later IS NULL OR __later >= __depth)")
    return j.select("file", "line", "j", "top", "kind", "own")


def _script(argv: Column) -> Column:
    """A command given as words: the script behind a shell's flag, else the words."""
    is_script = (F.size(argv) == 3) & F.get(argv, F.lit(0)).isin(*SCRIPT_SHELLS) & F.get(argv, F.lit(1)).isin(*SCRIPT_FLAGS)
    return F.when(is_script, F.get(argv, F.lit(2))).otherwise(F.coalesce(F.array_join(argv, " "), F.lit("")))


def _patch_of(command: Column) -> Column:
    """The patch in a command that starts with apply_patch, or null."""
    found = F.regexp_extract(command, r"(?s)\A\s*(?:apply_patch|applypatch).*?(\*\*\* Begin Patch.*?(?:\*\*\* End Patch|\z))", 1)
    return F.when(found != "", found)


def _text(value: str) -> Column:
    """A text, or the texts of its parts, a line each."""
    parts = F.try_variant_get("j", f"$.payload.{value}", "array<variant>")
    joined = F.array_join(F.filter(F.transform(parts, lambda x: _string(x, "$.text")), lambda x: x.isNotNull()), "\n")
    return F.coalesce(_p(value), joined, F.lit(""))


def calls_of(j: DataFrame) -> DataFrame:
    """(file, session, line, block, at, cwd, id, tool, action, arguments): calls of all kinds; polls of a process have tool write_stdin and the process as id2."""
    arguments = F.coalesce(F.try_parse_json(_p("arguments")), F.try_variant_get("j", "$.payload.arguments", "variant"), F.try_variant_get("j", "$.payload.action", "variant"))
    c = j.where(F.col("top") == "response_item").where(F.col("kind").isin("function_call", "custom_tool_call", "local_shell_call", "web_search_call")).withColumn("a", arguments)
    a = lambda path: _string(F.col("a"), f"$.{path}")
    local, search, custom = (F.col("kind") == k for k in ("local_shell_call", "web_search_call", "custom_tool_call"))
    name = F.when(local, "local_shell").when(search, "web_search").when(_p("name") == "container.exec", "shell").otherwise(_p("name"))
    words = F.try_variant_get("a", "$.command", "array<string>")
    command = F.when(local, _script(words)).when(custom, None).when(F.col("tool") == "exec_command", F.coalesce(a("cmd"), F.lit(""))).when(F.col("tool") == "shell_command", F.coalesce(a("command"), F.lit(""))).when(F.col("tool") == "shell", _script(words))
    c = c.withColumn("tool", name).withColumn("__command", command)
    patch = F.when(F.col("tool") == "apply_patch", F.coalesce(F.when(custom, _p("input")), a("input"), a("patch"), F.lit(""))).when(F.col("tool").isin("exec_command", "shell"), _patch_of(F.col("__command")))
    c = c.withColumn("patch", patch).withColumn("tool", F.when(F.col("patch").isNotNull(), "apply_patch").otherwise(F.col("tool")))
    run = F.col("tool").isin(*SHELLS)
    folder = F.coalesce(F.when(local, a("working_directory")), a("workdir"))
    inside = relative(F.when(folder.rlike(r"^[/~\\]") | F.col("cwd").isNull(), folder).otherwise(F.concat("cwd", F.lit("/"), folder)), F.col("cwd"))
    number = F.row_number().over(Window.partitionBy("file", "kind").orderBy("line"))
    known = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    c = c.withColumn("id", F.when(search, F.concat(F.lit("web_search_call "), number.cast("string"))).when(local, F.coalesce(_p("call_id"), _p("id"))).otherwise(_p("call_id")))
    c = c.where("tool IS NOT NULL AND id IS NOT NULL").where(~F.col("tool").isin(*BOOKKEEPING)).withColumn("c", shell.analysis(F.when(run, F.col("__command")), F.col("cwd")))
    # a command in a directory below the project's says so; the directory itself says nothing
    below = F.when((inside != ".") & ~inside.rlike(r"^(?:[/~\\]|\.\.)") & (inside != ""), inside)
    quoted = F.when(below.rlike(r"\A[A-Za-z0-9._\-/+@%,:=]+\z"), below).otherwise(F.concat(F.lit("'"), F.replace(below, F.lit("'"), F.lit(r"'\''")), F.lit("'")))
    said = F.when(below.isNotNull() & (F.col("c.text") != ""), F.concat(F.lit("cd "), quoted, F.lit(" && "), F.col("c.text"))).otherwise(F.col("c.text"))
    files = patches.patched_files(F.col("patch"))
    return c.select(
        "file", "session", "line", F.lit(0).alias("block"), "at", "cwd", "id", "tool", F.when(run, F.col("c.action")).otherwise(F.coalesce(known[F.col("tool")], F.lit("other"))).alias("action"), F.when(run, said).alias("command"),
        F.when(F.col("tool") == "view_image", a("path")).when(F.col("patch").isNotNull(), F.try_element_at(files, F.lit(1))["path"]).alias("path"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("url"),
        F.when(search, F.coalesce(a("query"), a("url"))).alias("query"), *(F.lit(None).cast("string").alias(x) for x in ("old", "new", "content")), "patch",
        F.when(F.col("tool") == "write_stdin", F.coalesce(F.try_variant_get("a", "$.session_id", "bigint").cast("string"), a("session_id"))).alias("process"), F.when(search, F.coalesce(_p("status"), F.lit("completed"))).alias("searched"),
    )


def header(output: Column) -> Column:
    """struct(code, running, wall_ms, output) of an output with a header; all null, and output too, without one."""
    whole = rf"\A((?:(?:{HEADER})[^\n]*(?:\n|\z))+)(?:Output:[^\S\n]*(?:\n|\z)([\s\S]*))?"
    last = lambda head, p: F.try_element_at(F.regexp_extract_all(head, F.lit(p), F.lit(1)), F.lit(-1))

    def fields(x: Column) -> Column:
        wall = F.regexp_extract(last(x["head"], r"(?m)^Wall time: ([^\n]*)$"), r"^\s*([0-9.]+(?:[eE][-+]?[0-9]+)?)\s*seconds\s*$", 1).try_cast("double")
        return F.struct(
            F.trim(last(x["head"], r"(?m)^(?:Process exited with code |Exit code: )([^\n]*)$")).try_cast("int").alias("code"), F.trim(last(x["head"], r"(?m)^Process running with session ID ([^\n]*)$")).alias("running"),
            F.round(wall * 1000).cast("bigint").alias("wall_ms"), F.when(x["head"] != "", x["rest"]).alias("output"),
        )

    return let(F.struct(F.regexp_extract(output, whole, 1).alias("head"), F.regexp_extract(output, whole, 2).alias("rest")), fields)


def stitched(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """One result a call: (session, line, block, id, failed, interrupted, output, exit_code, duration_ms).

    calls: from calls_of; outputs: file, session, line, id, text. A call whose output says that its process runs on gets what later polls of that process say, up to the first
    that ends it; a process that nobody sees end leaves its call without a result.
    """
    o = outputs.withColumn("h", header(F.col("text")))
    first = o.groupBy("file", "session", "id").agg(F.min_by(F.struct("line", "text", "h"), "line").alias("o")).select("file", "session", "id", "o.*")
    direct = first.join(calls.where("tool <> 'write_stdin'").select("file", "id", "tool"), ["file", "id"])
    begun = direct.where("h.running IS NOT NULL").select("file", "session", F.col("h.running").alias("process"), "line", F.col("id").alias("call"), F.col("h.output").alias("said"), F.col("h.wall_ms").alias("ms"), F.lit(None).cast("int").alias("code"), F.lit(False).alias("stopped"))
    polls = first.where("h.output IS NOT NULL").join(calls.where("tool = 'write_stdin'").select("file", "id", "process"), ["file", "id"])
    polls = polls.select("file", "session", "process", "line", F.lit(None).cast("string").alias("call"), F.col("h.output").alias("said"), F.col("h.wall_ms").alias("ms"), F.col("h.code").alias("code"), F.col("text").rlike(STOPPED).alias("stopped"))
    w = Window.partitionBy("file", "process").orderBy("line")
    runs = begun.unionByName(polls).withColumn("run", F.count("call").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("run > 0")
    ends = F.col("stopped") | F.col("code").isNotNull()
    over = F.max(ends).over(Window.partitionBy("file", "process", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("ends", ends).withColumn("over", F.coalesce(over, F.lit(False))).where("NOT over")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "")
    polled = runs.groupBy("file", "session", "process", "run").agg(F.max("call").alias("id"), joined.alias("output"), F.sum("ms").alias("duration_ms"), F.max("ends").alias("ended"), F.max("stopped").alias("interrupted"), F.max("code").alias("exit_code"), F.max("line").alias("line")).where("ended")
    polled = polled.select("session", "line", "id", F.coalesce(F.col("exit_code") != 0, F.lit(False)).alias("failed"), "interrupted", "output", F.when(~F.col("interrupted"), F.col("exit_code")).alias("exit_code"), "duration_ms")
    old = F.try_parse_json(F.ltrim("text"))
    code = F.try_variant_get(old, "$.metadata.exit_code", "int")
    stopped, bare = F.col("text").rlike(STOPPED), F.col("tool").isin(*SHELLS, "apply_patch")
    plain = direct.where("h.running IS NULL").withColumn("__old", code)
    plain = plain.select(
        "session", "line", "id",
        F.when(stopped, False).when(F.col("h.code").isNotNull(), F.col("h.code") != 0).when(F.col("__old").isNotNull(), F.col("__old") != 0).otherwise(bare).alias("failed"), stopped.alias("interrupted"),
        F.when(stopped, F.col("text")).when(F.col("h.code").isNotNull(), F.col("h.output")).when(F.col("__old").isNotNull(), F.coalesce(_string(old, "$.output"), F.lit(""))).otherwise(F.col("text")).alias("output"),
        F.when(~stopped, F.coalesce("h.code", "__old")).alias("exit_code"),
        F.when(~stopped, F.when(F.col("h.code").isNotNull(), F.col("h.wall_ms")).otherwise(F.round(F.try_variant_get(old, "$.metadata.duration_seconds", "double") * 1000).cast("bigint"))).alias("duration_ms"),
    )
    searches = calls.where("searched IS NOT NULL").select("session", "line", "id", F.lit(False).alias("failed"), (F.col("searched") != "completed").alias("interrupted"), F.lit("").alias("output"), F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("bigint").alias("duration_ms"))
    return polled.unionByName(plain).unionByName(searches).withColumn("block", F.lit(0))


def patch_ends(j: DataFrame) -> DataFrame:
    """(file, id, at_line, declined, success, made): what the log says that a patch did, the last word for each call."""
    ends = j.where((F.col("top") == "event_msg") & (F.col("kind") == "patch_apply_end")).where(_p("call_id").isNotNull())
    files = F.array_sort(F.map_entries(F.coalesce(F.try_variant_get("j", "$.payload.changes", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))

    def one(x: Column) -> Column:
        field = lambda name: _string(x["value"], f"$.{name}")
        body = F.coalesce(field("content"), F.lit(""))
        gone = let(text.created_diff(body), lambda d: F.struct(F.lit(0).alias("added"), d["added"].alias("removed"), d["starts"].alias("starts"), d["changed"].alias("changed")))
        diff = F.when(field("type") == "add", text.created_diff(body)).when(field("type") == "delete", gone).when(field("type") == "update", patches.patch_diff(F.coalesce(field("unified_diff"), F.lit(""))))
        return F.when(diff.isNotNull(), change_of(relative(F.coalesce(field("move_path"), x["key"]), F.col("cwd")), field("type") == "add", diff))

    made = F.filter(F.transform(files, one), lambda x: x.isNotNull()).cast(CHANGES)
    rows = ends.select("file", _p("call_id").alias("id"), "line", F.coalesce(_p("status") == "declined", F.lit(False)).alias("declined"), (F.coalesce(F.try_variant_get("j", "$.payload.success", "boolean"), F.lit(True)) & F.coalesce(_p("status") != "failed", F.lit(True))).alias("success"), made.alias("made"))
    return rows.groupBy("file", "id").agg(F.max_by(F.struct("declined", "success", "made"), "line").alias("r"), F.max("line").alias("at_line")).select("file", "id", "at_line", "r.*")


def rollout(lines: DataFrame) -> DataFrame:
    """Canonical events of rollout logs. Prompts are user_message events, or messages in files that have none."""
    j = carried(effective(lines), at=F.try_to_timestamp(_string(F.col("j"), "$.timestamp")), cwd=F.when(F.col("top").isin("session_meta", "turn_context"), F.regexp_replace(_p("cwd"), r"(?<=.)[/\\]+$", "")))
    j = j.withColumn("session", F.col("own")).where("session IS NOT NULL")
    asks = (F.col("top") == "event_msg") & (F.col("kind") == "user_message")
    j = j.withColumn("asks", F.coalesce(asks, F.lit(False))).withColumn("has", F.max("asks").over(Window.partitionBy("file")))
    told = (F.col("top") == "response_item") & (F.col("kind") == "message") & (_p("role") == "user") & ~F.col("has")
    prompts = j.where(F.col("asks") | told).withColumn("text", F.when(F.col("asks"), _p("message")).otherwise(_text("content"))).withColumn("block", F.lit(0))
    calls = calls_of(j)
    outputs = j.where((F.col("top") == "response_item") & F.col("kind").isin("function_call_output", "custom_tool_call_output")).select("file", "session", "line", _p("call_id").alias("id"), _text("output").alias("text"))
    results = stitched(calls, outputs)
    ends = calls.select("file", "session", "id").distinct().join(patch_ends(j), ["file", "id"]).drop("file")
    results = results.join(ends, ["session", "id"], "left").withColumn("__known", F.coalesce(F.col("at_line") < F.col("line"), F.lit(False)))
    declined, lost = F.col("__known") & F.col("declined"), F.col("__known") & ~F.col("success") & ~F.col("failed") & ~F.col("interrupted")
    results = results.select("session", "line", "block", "id", ((F.col("failed") | lost) & ~declined).alias("failed"), (F.col("interrupted") | declined).alias("interrupted"), "output", F.when(~lost, F.col("exit_code")).alias("exit_code"), "duration_ms", F.when(F.col("__known"), F.when(declined | lost, F.array().cast(CHANGES)).otherwise(F.col("made"))).alias("made"))
    return assemble(prompts, calls.where("tool <> 'write_stdin'"), results, "rollout")
