"""Further session-log dialects, each mapped to prompts, calls and results by JSON functions and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.patches import heredoc_patch
from tracemill.operators.sessions import live_chain
from tracemill.sources.rollout import rollout
from tracemill.sources.split import rejoined
from tracemill.sources.transcripts import _string, assemble, carried, named, parsed

# What the tools of each dialect do.
REPLAY = {"run_shell_command": "run", "read_file": "read", "read_many_files": "read", "list_directory": "search", "glob": "search", "search_file_content": "search", "grep_search": "search", "replace": "edit", "edit": "edit", "write_file": "edit", "web_fetch": "fetch", "google_web_search": "fetch", "web_search": "fetch", "task": "delegate"}
EVENTS = {"bash": "run", "view": "read", "create": "edit", "str_replace": "edit", "edit": "edit", "insert": "edit", "apply_patch": "edit", "grep": "search", "glob": "search", "web_fetch": "fetch", "task": "delegate"}
MESSAGES = {"Execute": "run", "Read": "read", "LS": "search", "Edit": "edit", "MultiEdit": "edit", "Create": "edit", "ApplyPatch": "edit", "Grep": "search", "Glob": "search", "FetchUrl": "fetch", "WebSearch": "fetch", "Task": "delegate"}
DENIED = "(?i)user (?:denied|rejected|cancelled|canceled|declined)|operation cancelled|permission denied by user|aborted by user"


def _arguments(j: Column) -> list[Column]:
    at = lambda *paths: F.coalesce(*(_string(j, f"$.{p}") for p in paths))
    listed = F.try_variant_get(j, "$.command", "array<string>")
    script = F.when(F.size(listed) == 3, F.when(F.get(listed, F.lit(1)).isin("-lc", "-c"), F.get(listed, F.lit(2))))
    command = F.coalesce(at("command", "cmd", "script"), script, F.array_join(listed, " "))
    patch = F.coalesce(at("patch", "input"), F.when(command.rlike("apply_?patch"), heredoc_patch(command)))
    edit = [at("old_string", "old_str", "oldText").alias("old"), at("new_string", "new_str", "newText").alias("new"), at("content", "file_text").alias("content"), patch.alias("patch")]
    return [*edit, command.alias("command"), at("file_path", "path", "absolute_path", "notebook_path", "filePath", "dir_path").alias("path"), at("pattern").alias("pattern"), at("url").alias("url"), at("query").alias("query")]


def _exit(output: Column) -> Column:
    found = F.regexp_extract_all(output, F.lit(r"(?im)(?:process exited with code|exit code:?|exited with code|exit status)\s*:?\s*(-?\d+)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("int")


def replay(lines: DataFrame) -> DataFrame:
    """Messages by id, the last write at the place of the first; a rewind drops its target and all after it."""
    s = lambda path: _string(F.col("j"), f"$.{path}")
    j = carried(parsed(lines), session=s("sessionId"), cwd=s("cwd"))
    records = j.where(s("id").isNotNull()).groupBy("file", s("id").alias("mid")).agg(F.min("line").alias("line"), F.max("line").alias("last"), F.max_by(F.struct("j", "session", "cwd"), "line").alias("r")).select("file", "mid", "line", "last", "r.*")
    rewinds = j.where(s("`$rewindTo`").isNotNull() | F.try_variant_get("j", "$['$rewindTo']", "string").isNotNull()).select("file", F.col("line").alias("rline"), F.try_variant_get("j", "$['$rewindTo']", "string").alias("target"))
    spans = rewinds.join(records.select("file", F.col("mid").alias("target"), F.col("line").alias("tline")), ["file", "target"], "left").select("file", "rline", F.coalesce("tline", F.lit(0)).alias("tline"))
    # records and rewinds in one order: a record goes if a later rewind, behind its last write too, reaches back to its first
    later = Window.partitionBy("file").orderBy(F.desc("last"), F.desc("rline")).rowsBetween(Window.unboundedPreceding, 0)
    marks = records.withColumn("rline", F.lit(None).cast("int")).withColumn("tline", F.lit(None).cast("int")).unionByName(spans.withColumn("last", F.col("rline")), allowMissingColumns=True)
    live = marks.withColumn("back", F.min("tline").over(later)).where("mid IS NOT NULL AND (back IS NULL OR line < back)").drop("rline", "tline", "back").withColumn("at", F.try_to_timestamp(s("timestamp")))
    prompts = live.where(s("type") == "user").withColumn("text", F.coalesce(s("displayContent"), s("content"), s("content[0].text"))).withColumn("block", F.lit(0))
    t = lambda path: _string(F.col("t"), f"$.{path}")
    tools = live.select("session", "line", "at", "cwd", F.posexplode(F.try_variant_get("j", "$.toolCalls", "array<variant>")).alias("block", "t"))
    calls = tools.withColumn("a", F.try_variant_get("t", "$.args", "variant")).select("session", "line", "block", "at", "cwd", t("id").alias("id"), t("name").alias("tool"), *_arguments(F.col("a")))
    output = F.coalesce(t("result[0].functionResponse.response.output"), t("result[0].functionResponse.response.error"), t("resultDisplay"))
    code = _exit(output)
    results = tools.select("session", "line", "block", t("id").alias("id"), ((t("status") == "error") | F.coalesce(code != 0, F.lit(False))).alias("failed"), ((t("status") == "cancelled") | F.coalesce(output.rlike(DENIED), F.lit(False))).alias("interrupted"), output.alias("output"), code.alias("exit_code"), F.lit(None).cast("bigint").alias("duration_ms"))
    return assemble(prompts, calls.withColumn("action", named(REPLAY, F.col("tool"))), results, "replay")


def chain(lines: DataFrame) -> DataFrame:
    """Records with a parent each; only the branch that ends in the last record counts. Fragments of one record are read in a row."""
    s = lambda path: _string(F.col("j"), f"$.{path}")
    j = carried(parsed(lines), session=s("sessionId"), cwd=s("cwd"), at=F.try_to_timestamp(s("timestamp"))).withColumn("uuid", s("uuid")).where("uuid IS NOT NULL")
    live = live_chain(j.select("file", "uuid", s("parentUuid").alias("parent"), "line"), "file", "uuid", "parent", "line")
    kept = j.join(live, ["file", "uuid"], "left_semi")
    parts = kept.select("session", "line", "at", "cwd", s("type").alias("role"), F.posexplode(F.try_variant_get("j", "$.message.parts", "array<variant>")).alias("block", "b"))
    b = lambda path: _string(F.col("b"), f"$.{path}")
    thought = F.coalesce(F.try_variant_get("b", "$.thought", "boolean"), F.lit(False))
    prompts = parts.where((F.col("role") == "user") & ~thought).withColumn("text", b("text"))
    calls = parts.where(b("functionCall.name").isNotNull()).withColumn("a", F.try_variant_get("b", "$.functionCall.args", "variant")).select("session", "line", "block", "at", "cwd", b("functionCall.id").alias("id"), b("functionCall.name").alias("tool"), *_arguments(F.col("a")))
    output = F.coalesce(b("functionResponse.response.output"), b("functionResponse.response.error"))
    code = _exit(output)
    results = parts.where(b("functionResponse.id").isNotNull()).select("session", "line", "block", b("functionResponse.id").alias("id"), (b("functionResponse.response.error").isNotNull() | F.coalesce(code != 0, F.lit(False))).alias("failed"), F.coalesce(output.rlike(DENIED), F.lit(False)).alias("interrupted"), output.alias("output"), code.alias("exit_code"), F.lit(None).cast("bigint").alias("duration_ms"))
    return assemble(prompts, calls.withColumn("action", named(REPLAY, F.col("tool"))), results, "chain")


def typed_events(lines: DataFrame) -> DataFrame:
    """{type, timestamp, data} lines: session.start, user.message, tool.execution_start and tool.execution_complete. Broken records are put together again."""
    d = lambda path: _string(F.col("j"), f"$.data.{path}")
    parent = F.try_variant_get("j", "$.data.parentToolCallId", "string")
    own = parsed(rejoined(lines)).where(~F.coalesce(F.try_variant_get("j", "$.ephemeral", "boolean"), F.lit(False)) & parent.isNull())
    j = carried(own, session=d("sessionId"), cwd=F.coalesce(d("context.cwd"), d("cwd")), at=F.try_to_timestamp(_string(F.col("j"), "$.timestamp"))).withColumn("kind", _string(F.col("j"), "$.type"))
    j = j.where(_string(F.col("j"), "$.agentId").isNull()).withColumn("block", F.lit(0))
    prompts = j.where((F.col("kind") == "user.message") & F.coalesce(d("source"), F.lit("user")).isin("user", "")).withColumn("text", d("content"))
    calls = j.where("kind = 'tool.execution_start'").withColumn("a", F.try_variant_get("j", "$.data.arguments", "variant")).select("session", "line", "block", "at", "cwd", d("toolCallId").alias("id"), d("toolName").alias("tool"), *_arguments(F.col("a")))
    output = F.coalesce(d("result.content"), d("error.message"))
    marker = F.try_element_at(F.regexp_extract_all(output, F.lit(r"(?m)^<[^\n>]*exit code (-?\d+)>\s*$"), F.lit(1)), F.lit(-1)).try_cast("int")
    code = F.coalesce(F.try_variant_get("j", "$.data.result.exitCode", "int"), marker)
    bad = ~F.coalesce(F.try_variant_get("j", "$.data.success", "boolean"), F.lit(True)) | F.coalesce(code != 0, F.lit(False))
    refused = F.coalesce(d("error.code").rlike("(?i)denied|rejected|cancel|abort"), F.lit(False)) | F.coalesce(output.rlike(DENIED), F.lit(False))
    results = j.where("kind = 'tool.execution_complete'").select("session", "line", "block", d("toolCallId").alias("id"), bad.alias("failed"), refused.alias("interrupted"), output.alias("output"), code.alias("exit_code"), F.lit(None).cast("bigint").alias("duration_ms"))
    return assemble(prompts, calls.withColumn("action", named(EVENTS, F.col("tool"))), results, "typed_events")


def headed_messages(lines: DataFrame) -> DataFrame:
    """A session_start header and message lines with content blocks."""
    s = lambda path: _string(F.col("j"), f"$.{path}")
    start = s("type") == "session_start"
    j = carried(parsed(lines), session=F.when(start, s("id")), cwd=F.when(start, s("cwd")), at=F.try_to_timestamp(s("timestamp"))).where(s("type") == "message")
    shown = F.coalesce(s("visibility"), F.lit("both")) != "llm_only"
    parts = j.select("session", "line", "at", "cwd", s("message.role").alias("role"), shown.alias("shown"), F.posexplode(F.try_variant_get("j", "$.message.content", "array<variant>")).alias("block", "b"))
    b = lambda path: _string(F.col("b"), f"$.{path}")
    prompts = parts.where((F.col("role") == "user") & F.col("shown") & (b("type") == "text")).withColumn("text", b("text"))
    calls = parts.where(b("type") == "tool_use").withColumn("a", F.try_variant_get("b", "$.input", "variant")).select("session", "line", "block", "at", "cwd", b("id").alias("id"), b("name").alias("tool"), *_arguments(F.col("a")))
    output = F.coalesce(b("content"), b("content[0].text"))
    edge = F.concat_ws("\n", F.regexp_extract(F.trim(output), r"^([^\n]*)", 1), F.regexp_extract(F.trim(output), r"([^\n]*)$", 1))
    code = _exit(edge)
    bad = F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False)) | F.coalesce(code != 0, F.lit(False))
    results = parts.where(b("type") == "tool_result").select("session", "line", "block", b("tool_use_id").alias("id"), bad.alias("failed"), F.coalesce(output.rlike(DENIED), F.lit(False)).alias("interrupted"), output.alias("output"), code.alias("exit_code"), F.lit(None).cast("bigint").alias("duration_ms"))
    return assemble(prompts, calls.withColumn("action", named(MESSAGES, F.col("tool"))), results, "headed_messages")


DIALECTS: dict[str, Callable[[DataFrame], DataFrame]] = {"rollout": rollout, "replay": replay, "chain": chain, "typed_events": typed_events, "headed_messages": headed_messages}
