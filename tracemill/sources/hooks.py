"""Hook payloads of agents as one table of moments.

A moment is (dialect, session, cwd, transcript, moment, text, continued); moment is one of start, prompt, failed (a command
failed; text is what it said), turn end, compacting, end. Payloads are read by JSON functions; one that is no JSON, or
of an unknown event, gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.sources.dialects import _exit
from tracemill.sources.transcripts import _string

# What the events of each dialect are. "done" is a tool's end, which counts where it failed.
USUAL = {"SessionStart": "start", "UserPromptSubmit": "prompt", "Stop": "turn end", "PreCompact": "compacting", "SessionEnd": "end"}
MOMENTS = {
    "session_log": {**USUAL, "PostToolUseFailure": "failed"},
    "rollout": {**USUAL, "PostToolUse": "done"},
    "replay": {"SessionStart": "start", "BeforeAgent": "prompt", "AfterTool": "done", "AfterAgent": "turn end", "PreCompress": "compacting", "SessionEnd": "end"},
    "chain": {**USUAL, "PostToolUseFailure": "failed"},
    "headed_messages": {**USUAL, "PostToolUse": "done", "PostToolUseFailure": "failed"},
    "typed_events": {
        **USUAL, "PostToolUse": "done", "PostToolUseFailure": "failed", "sessionStart": "start", "userPromptSubmitted": "prompt", "postToolUse": "done", "postToolUseFailure": "failed",
        "agentStop": "turn end", "preCompact": "compacting", "sessionEnd": "end",
    },
    "journal": {"sessionStart": "start", "beforeSubmitPrompt": "prompt", "postToolUse": "done", "postToolUseFailure": "failed", "afterFileEdit": "edit", "stop": "turn end", "preCompact": "compacting", "sessionEnd": "end"},
}
SHELLS = ("Bash", "bash", "Execute", "Shell", "run_shell_command", "shell", "powershell")
DECLINED = ("rejected", "denied by the user", "user denied", "cancelled", "canceled", "aborted")
OUTPUTS = ("stdout", "stderr", "output", "content", "result", "aggregated_output")
CODES = ("exitCode", "exit_code", "returnCode", "return_code", "code", "status")


def _flag(j: Column, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(j, f"$.{p}", "boolean") for p in paths), F.lit(False))


def _event(j: Column) -> Column:
    """The event's name, or what the fields of a payload without one tell."""
    has = lambda *names: F.coalesce(*(F.try_variant_get(j, f"$.{n}", "variant") for n in names)).isNotNull()
    guessed = (
        F.when(has("agentName", "agent_name", "transformedPrompt", "transformed_prompt"), None)
        .when(has("toolName", "tool_name"), F.when(has("toolResult", "tool_result"), "postToolUse").when(has("error"), "postToolUseFailure"))
        .when(has("prompt"), "userPromptSubmitted").when(has("stopReason", "stop_reason"), "agentStop").when(has("trigger"), "preCompact").when(has("reason"), "sessionEnd").when(has("source"), "sessionStart")
    )
    return F.coalesce(_string(j, "$.hook_event_name"), _string(j, "$.hookEventName"), guessed)


def _failure(j: Column) -> Column:
    """What a failed command said; null if it didn't fail, was stopped or refused, or said nothing."""
    plain = F.coalesce(_string(j, "$.tool_response"), _string(j, "$.tool_output"), _string(j, "$.tool_result"))
    found = F.coalesce(F.try_variant_get(j, "$.tool_response", "variant"), F.try_variant_get(j, "$.tool_output", "variant"), F.try_variant_get(j, "$.toolResult", "variant"), F.try_variant_get(j, "$.tool_result", "variant"))
    r = F.coalesce(F.try_parse_json(plain), found)
    error = F.coalesce(_string(r, "$.error"), _string(r, "$.error.message"))
    said = [F.when(F.trim(x) != "", x) for x in (*(_string(r, f"$.{n}") for n in OUTPUTS), _string(r, "$.textResultForLlm"), _string(r, "$.text_result_for_llm"), error)]
    output = F.coalesce(F.when(F.try_parse_json(plain).isNull(), plain), F.concat_ws("\n", *said))
    code = F.coalesce(*(F.try_variant_get(r, f"$.{n}", "bigint") for n in CODES))
    bad = F.when(code.isNotNull(), code != 0).otherwise(
        _flag(r, "is_error", "isError") | F.coalesce(~F.try_variant_get(r, "$.success", "boolean"), F.lit(False)) | F.coalesce(error != "", F.lit(False)) | F.coalesce(_exit(output) != 0, F.lit(False))
        | F.coalesce(F.coalesce(_string(r, "$.resultType"), _string(r, "$.result_type")) == "failure", F.lit(False))
    )
    return F.when(bad & ~_flag(r, "interrupted", "isInterrupt") & (F.trim(output) != ""), output)


def moments(payloads: DataFrame) -> DataFrame:
    """Moments of payloads (dialect, payload). Batch or stream: each row stands for itself."""
    j = F.col("j")
    s = lambda *names: F.coalesce(*(_string(j, f"$.{n}") for n in names))
    known = F.create_map(*(x for d, own in MOMENTS.items() for e, m in own.items() for x in (F.lit(f"{d} {e}"), F.lit(m))))
    rows = payloads.withColumn("j", F.try_parse_json("payload")).where("j IS NOT NULL").withColumn("event", _event(j))
    rows = rows.withColumn("kind", known[F.concat_ws(" ", "dialect", "event")])
    editor = F.col("dialect") == "journal"
    session = F.when(editor, s("conversation_id", "session_id")).otherwise(s("session_id", "sessionId"))
    root = F.try_variant_get(j, "$.workspace_roots[0]", "string")
    cwd = F.coalesce(F.when(s("cwd").startswith("/"), s("cwd")), F.when(editor, root))
    # another agent's copy of the payload, and prompts of subagents, are not its own
    foreign = F.col("dialect").isin("session_log", "replay", "chain", "headed_messages") & s("cursor_version").isNotNull()
    inner = (F.col("dialect") == "rollout") & F.try_variant_get(j, "$.agent_id", "variant").isNotNull()
    prompt = F.when(F.col("dialect") == "chain", s("submitted_prompt")).when(~inner, s("prompt"))
    shell = s("tool_name", "toolName").isin(*SHELLS)
    stopped = _flag(j, "is_interrupt") | F.coalesce(s("failure_type") == "permission_denied", F.lit(False))
    error = F.coalesce(s("error", "error_message"), _string(j, "$.error.message"))
    declined = F.lit(False)
    for phrase in DECLINED:
        declined = declined | F.contains(F.lower(error), F.lit(phrase))
    refused = (F.col("dialect") == "typed_events") & F.coalesce(declined, F.lit(False))
    text = F.when(F.col("kind") == "prompt", prompt).when(F.col("kind") == "failed", F.when(shell & ~stopped & ~refused, error)).when(F.col("kind") == "done", F.when(shell, _failure(j)))
    moment = F.when(F.col("kind") == "done", "failed").otherwise(F.col("kind"))
    needs = F.col("kind").isin("prompt", "failed", "done")
    continued = F.when(F.col("kind") == "turn end", F.when(editor, F.coalesce(F.try_variant_get(j, "$.loop_count", "bigint"), F.lit(0)) > 0).otherwise(_flag(j, "stop_hook_active", "stopHookActive")))
    out = rows.where(F.col("kind").isNotNull() & (F.col("kind") != "edit") & ~foreign).select(
        "dialect", session.alias("session"), cwd.alias("cwd"), F.when(s("transcript_path", "transcriptPath") != "", s("transcript_path", "transcriptPath")).alias("transcript"),
        moment.alias("moment"), text.alias("text"), F.coalesce(continued, F.lit(False)).alias("continued"), needs.alias("needs"),
    )
    return out.where("session IS NOT NULL AND session <> '' AND cwd IS NOT NULL AND (NOT needs OR trim(text) <> '')").drop("needs")
