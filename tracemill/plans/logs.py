"""Session logs in every dialect, made from conversations: user turns are prompts, assistant turns run a command.

By number a turn's call has no result, succeeds, or fails with exit code 1, so one SQL statement has the events of all dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import sessions
from tracemill.plans.common import EVENTS as NUMBERED
from tracemill.plans.common import events, json_of, registrar, table
from tracemill.sources import hooks, split, transcripts
from tracemill.sources.dialects import DIALECTS

query, QUERIES, ORACLE = registrar()

EVENTS = """SELECT 's' || conv_id AS session, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seq, CASE role WHEN 'user' THEN 'prompt' ELSE 'tool_call' END AS type,
  CASE role WHEN 'user' THEN 'do task ' || turn END AS prompt, CASE role WHEN 'assistant' THEN 'make check ' || turn END AS command, CASE role WHEN 'assistant' THEN ['interrupted', 'succeeded', 'failed'][turn % 3 + 1] END AS status
  FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant'))"""


def lines(spark, d, dialect: str) -> DataFrame:
    """(file, line, value): the conversations as logs of a dialect, one file each; a header goes first."""
    rows = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role").distinct()
    session, turn = F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.col("turn").cast("string")
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 10), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ask, run, key = F.concat(F.lit("do task "), turn), F.concat(F.lit("make check "), turn), F.concat(F.lit("c"), turn)
    bad, user = F.col("turn") % 3 == 2, F.col("role") == "user"
    said = F.when(bad, "broken\nExit code 1").otherwise("fine\nExit code 0")
    top = {"sessionId": session, "timestamp": at, "cwd": "/work"}
    if dialect == "session_log":
        prompt = json_of(type="user", **top, message={"content": ask})
        call = json_of(type="assistant", **top, message={"content": [{"type": "tool_use", "id": key, "name": "Bash", "input": {"command": run}}]})
        result = json_of(type="user", **top, message={"content": [{"type": "tool_result", "tool_use_id": key, "content": said, "is_error": bad}]})
        head = None
    elif dialect == "rollout":
        head = json_of(timestamp=at, type="session_meta", payload={"id": session, "cwd": "/work"})
        prompt = json_of(timestamp=at, type="event_msg", payload={"type": "user_message", "message": ask})
        call = json_of(timestamp=at, type="response_item", payload={"type": "function_call", "name": "exec_command", "call_id": key, "arguments": json_of(cmd=run)})
        result = json_of(timestamp=at, type="response_item", payload={"type": "function_call_output", "call_id": key, "output": F.when(bad, "Exit code: 1\nOutput:\nbroken").otherwise("Exit code: 0\nOutput:\nfine")})
    elif dialect == "replay":
        head = None
        prompt = json_of(id=F.concat(F.lit("m"), turn), type="user", content=ask, **top)
        of = lambda more: json_of(id=F.concat(F.lit("m"), turn), type="gemini", **top, toolCalls=[{"id": key, "name": "run_shell_command", "args": {"command": run}, **more}])
        call = F.when(F.col("turn") % 3 == 0, of({"status": "cancelled"})).otherwise(of({"status": "success", "result": [{"functionResponse": {"response": {"output": said}}}]}))
        result = F.lit(None).cast("string")
    elif dialect == "chain":
        head = None
        before = F.lag(F.concat(F.lit("u"), turn)).over(_by_turn())
        rows = rows.withColumn("before", before)
        own = {"uuid": F.concat(F.lit("u"), turn), "parentUuid": F.col("before"), **top}
        prompt = json_of(type="user", **own, message={"parts": [{"text": ask}]})
        call = json_of(type="assistant", **own, message={"parts": [{"functionCall": {"id": key, "name": "run_shell_command", "args": {"command": run}}}]})
        result = json_of(type="tool_result", **own, message={"parts": [{"functionResponse": {"id": key, "response": {"output": said}}}]})
    elif dialect == "typed_events":
        head = json_of(type="session.start", timestamp=at, data={"sessionId": session, "context": {"cwd": "/work"}})
        prompt = json_of(type="user.message", timestamp=at, data={"content": ask})
        call = json_of(type="tool.execution_start", timestamp=at, data={"toolCallId": key, "toolName": "bash", "arguments": {"command": run}})
        result = json_of(type="tool.execution_complete", timestamp=at, data={"toolCallId": key, "success": ~bad, "result": {"content": F.when(bad, "broken\n<exited with exit code 1>").otherwise("fine")}})
    else:
        head = json_of(type="session_start", id=session, cwd="/work", timestamp=at)
        prompt = json_of(type="message", timestamp=at, message={"role": "user", "content": [{"type": "text", "text": ask}]})
        call = json_of(type="message", timestamp=at, message={"role": "assistant", "content": [{"type": "tool_use", "id": key, "name": "Execute", "input": {"command": run}}]})
        result = json_of(type="message", timestamp=at, message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": key, "content": said, "is_error": bad}]})
    first = F.row_number().over(_by_turn()) == 1
    rows = rows.withColumn("first", first).withColumn("own", F.array(*([F.when(F.col("first"), head)] if head is not None else []), F.when(user, prompt).otherwise(call), F.when(~user & (F.col("turn") % 3 != 0), result)))
    out = rows.select(session.alias("file"), "turn", F.posexplode("own").alias("n", "value")).where("value IS NOT NULL")
    return out.select("file", (F.col("turn") * 4 + F.col("n")).cast("int").alias("line"), "value")


def _by_turn():
    return Window.partitionBy("conv_id").orderBy("turn", "role")


def _register(name: str, dialect: str) -> None:
    read = transcripts.session_log if dialect == "session_log" else DIALECTS[dialect]

    def run(spark, d):
        return read(lines(spark, d, dialect)).select("session", "seq", "type", "prompt", "command", "status")

    run.__name__ = name
    query(EVENTS)(run)


for number, dialect in enumerate(("session_log", "rollout", "replay", "chain", "typed_events", "headed_messages")):
    _register(f"q{100 + number}_{dialect}", dialect)


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END AS up FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn IS NOT NULL)),
  l AS (SELECT conv_id, max(turn) AS turn FROM r GROUP BY 1 UNION SELECT l.conv_id, p.turn FROM l JOIN r c ON c.conv_id = l.conv_id AND c.turn = l.turn JOIN r p ON p.conv_id = c.conv_id AND p.turn = c.up)
  SELECT conv_id, turn FROM l""")
def q95_live_chain(spark, d):
    turn = F.col("turn")
    rows = table(spark, d, "conversations").where(turn.isNotNull()).withColumn("up", F.when(turn % 4 == 3, turn - 2).otherwise(turn - 1))
    return sessions.live_chain(rows, "conv_id", "turn", "up", "turn").select("conv_id", "turn")


@query("""SELECT 's' || user_id AS session, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'prompt' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'turn end' END AS moment,
  CASE event_type WHEN 'view' THEN 'ask ' || event_id WHEN 'error' THEN 'said ' || event_id END AS text, event_type = 'purchase' AND event_id % 2 = 0 AS continued
  FROM events WHERE event_type IN ('signup', 'view', 'purchase') OR event_type = 'error' AND event_id % 3 <> 0""")
def q106_hook_moments(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id").cast("string")
    own = {"session_id": F.concat(F.lit("s"), F.col("user_id").cast("string")), "cwd": "/work", "transcript_path": i}
    kind = F.col("event_type")
    payload = (
        F.when(kind == "signup", json_of(hook_event_name="SessionStart", **own))
        .when(kind == "view", json_of(hook_event_name="UserPromptSubmit", prompt=F.concat(F.lit("ask "), i), **own))
        .when(kind == "error", json_of(hook_event_name="PostToolUseFailure", tool_name="Bash", error=F.concat(F.lit("said "), i), is_interrupt=F.col("event_id") % 3 == 0, **own))
        .when(kind == "purchase", json_of(hook_event_name="Stop", stop_hook_active=F.col("event_id") % 2 == 0, **own))
        .otherwise("no payload")
    )
    out = hooks.moments(e.select(F.lit("session_log").alias("dialect"), payload.alias("payload")))
    return out.select("session", F.col("transcript").cast("bigint").alias("event_id"), "moment", "text", "continued")


@query(f"""WITH {NUMBERED}, x AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM ev),
  s AS (SELECT *, sum(CASE type WHEN 'view' THEN 1 WHEN 'signup' THEN -(k % 3) ELSE 0 END) OVER w AS s FROM x WINDOW w AS (PARTITION BY session ORDER BY seq)),
  dep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY session ORDER BY seq)) AS depth FROM s),
  kept AS (SELECT *, min(CASE WHEN type = 'signup' AND k % 3 > 0 THEN depth END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM dep)
  SELECT 's' || session AS session, CAST(row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS INT) AS seq, CASE type WHEN 'view' THEN 'ask ' || event_id END AS prompt, CASE WHEN type <> 'view' THEN 'make ' || event_id END AS command,
    CASE type WHEN 'view' THEN NULL WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status, CASE type WHEN 'error' THEN 3 END AS exit_code, CAST(CASE type WHEN 'click' THEN 1000 WHEN 'error' THEN 1500 WHEN 'purchase' THEN 2000 END AS BIGINT) AS duration_ms
  FROM kept WHERE type <> 'signup' AND (later IS NULL OR later >= depth)""")
def q122_rollbacks_and_polls(spark, d):
    """Events as rollouts of forked sessions: clicks answer at once, errors after one poll, purchases after two; signups take turns back."""
    e = events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    own, i, at = F.concat(F.lit("s"), F.col("session").cast("string")), F.col("event_id").cast("string"), "2024-01-01T00:00:00Z"
    told = lambda kind, **more: json_of(timestamp=at, type="event_msg", payload={"type": kind, **more})
    item = lambda kind, **more: json_of(timestamp=at, type="response_item", payload={"type": kind, **more})
    call = item("function_call", name="exec_command", call_id=i, arguments=json_of(cmd=F.concat(F.lit("make "), i)))
    poll = lambda n: item("function_call", name="write_stdin", call_id=F.concat(i, F.lit(f"p{n}")), arguments=json_of(session_id=F.col("k")))
    out = lambda n, said: item("function_call_output", call_id=F.concat(i, F.lit(n)), output=said)
    runs = F.concat(F.lit("Wall time: 1 seconds\nProcess running with session ID "), F.col("k").cast("string"), F.lit("\nOutput:\nfirst"))
    more = F.concat(F.lit("Wall time: 0.5 seconds\nProcess running with session ID "), F.col("k").cast("string"))
    kind = F.col("type")
    lines_ = (
        F.when(kind == "view", F.array(told("user_message", message=F.concat(F.lit("ask "), i))))
        .when(kind == "click", F.array(call, out("", F.lit("Exit code: 0\nWall time: 1 seconds\nOutput:\nok"))))
        .when(kind == "error", F.array(call, out("", runs), poll(1), out("p1", F.lit("Wall time: 0.5 seconds\nProcess exited with code 3\nOutput:\nerror: e"))))
        .when(kind == "purchase", F.array(call, out("", runs), poll(1), out("p1", more), poll(2), out("p2", F.lit("Wall time: 0.5 seconds\nExit code: 0"))))
        .otherwise(F.array(told("thread_rolled_back", num_turns=F.col("k") % 3)))
    )
    rows = e.select(own.alias("file"), "seq", F.posexplode(lines_).alias("n", "value")).select("file", (F.col("seq") * 10 + F.col("n") + 10).cast("int").alias("line"), "value")
    meta = lambda name: json_of(timestamp=at, type="session_meta", payload={"id": name, "cwd": "/work"})
    turn = lambda name: json_of(timestamp=at, type="turn_context", payload={"turn_id": name})
    head = F.array(meta(own), meta(F.concat(F.lit("r"), own)), turn(F.lit("a")), told("user_message", message=F.lit("copied")), turn(F.lit("z")))
    heads = e.select("session").distinct().select(own.alias("file"), F.posexplode(head).alias("line", "value"))
    return DIALECTS["rollout"](heads.unionByName(rows)).select("session", "seq", "prompt", "command", "status", "exit_code", "duration_ms")


@query("""SELECT conv_id, turn, CASE WHEN trim(text) LIKE 'Caveat:%' THEN NULL ELSE nullif(rtrim(left(split_part(regexp_replace(text, '^\\s+', ''), chr(10), 1), 200)), '') END AS summary
  FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def q123_prompt_summaries(spark, d):
    """Prompts with reminders planted before them, over several lines or on one, are remembered by what follows."""
    rows = table(spark, d, "conversations").where("role = 'user' AND text IS NOT NULL")
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n <system-reminder id=1>\n be brief > and\n\nkind </system-reminder>  "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<pasted_content a>x</pasted_content> "), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", text.summary(wrapped, "session_log").alias("summary"))


@query("""SELECT 'f' || doc_id % 8 AS file, doc_id, length(text) AS chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL""")
def q124_split_records(spark, d):
    """Documents as records of a log that broke at every line end within a text; long ones have few lines, so that all can be mended."""
    body = F.col("text")
    docs = table(spark, d, "documents").where(body.isNotNull())
    record = json_of(type="t", doc_id=F.col("doc_id"), body=F.array_join(F.transform(F.split(body, "\n"), lambda x: x), "\n"))
    few = F.size(F.split(body, "\n")) <= split.MOST_LINES
    lines_ = F.split(F.when(few, F.regexp_replace(record, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")).otherwise(record), "\n")
    rows = docs.select(F.concat(F.lit("f"), (F.col("doc_id") % 8).cast("string")).alias("file"), "doc_id", F.posexplode(lines_).alias("n", "value"))
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("doc_id", "n")))
    found = split.rejoined(rows.select("file", "line", "value")).withColumn("j", F.parse_json("value"))
    said = F.try_variant_get("j", "$.body", "string")
    return found.select("file", F.try_variant_get("j", "$.doc_id", "bigint").alias("doc_id"), F.length(said).cast("bigint").alias("chars"), F.md5(said.cast("binary")).alias("digest"))
