"""The live path as queries: documents stand for files of logs, and the queue of ingests is drained from a stream over the events file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemill.plans.common import json_of, registrar, table
from tracemill.sources import files
from tracemill.streaming import drain
from tracemill.tables import scratch_dir

query, QUERIES, ORACLE = registrar()

KNOWN = ("click", "view", "purchase")


def _queue(rows):
    transcript = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("/logs/"), F.col("user_id").cast("string")))
    return rows.select(F.col("event_type").alias("harness"), transcript.alias("transcript"), (F.get_json_object("props", "$.k").cast("int") % 10 == 0).alias("ended"), F.col("ts").cast("timestamp").alias("at"))


@query("""WITH q AS (SELECT event_type AS harness, CASE WHEN event_id % 11 <> 0 THEN '/logs/' || user_id END AS transcript, json_extract_string(props, '$.k')::INT % 10 = 0 AS ended FROM events)
  SELECT harness, transcript, bool_or(ended) AS ended, count(*) AS queued, NULL AS reason FROM q WHERE transcript IS NOT NULL AND harness IN ('click', 'view', 'purchase') GROUP BY 1, 2
  UNION ALL SELECT harness, transcript, ended, NULL, CASE WHEN transcript IS NULL THEN 'no transcript' ELSE 'unsupported harness' END FROM q WHERE transcript IS NULL OR harness NOT IN ('click', 'view', 'purchase')""")
def q134_drained(spark, d):
    folder = f"{scratch_dir(spark)}/drain-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    drain.drained(_queue(stream), KNOWN, lambda asked: asked, folder, f"{folder}/checkpoint").awaitTermination()
    done = drain.kept(spark, folder, "done", drain.DONE).select("harness", "transcript", "ended", "queued", F.lit(None).cast("string").alias("reason"))
    refused = drain.kept(spark, folder, "refused", drain.REFUSED)
    return done.unionByName(refused.select("harness", "transcript", "ended", F.lit(None).cast("bigint").alias("queued"), "reason"))


@query("""WITH s AS (SELECT event_type AS harness, user_id AS session, max(ts) AS updated_at, CASE WHEN user_id % 9 <> 0 THEN max(ts) + INTERVAL 10 MINUTE END AS changed_at FROM events GROUP BY event_type, user_id),
  i AS (SELECT *, row_number() OVER (PARTITION BY harness ORDER BY updated_at, session) AS n FROM s WHERE changed_at IS NULL OR changed_at < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE) SELECT harness, session, epoch_us(updated_at) AS updated FROM i WHERE n <= 4""")
def q135_idle_asked(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    changed = F.when(F.col("user_id") % 9 != 0, F.max("ts") + F.expr("INTERVAL 10 MINUTES"))
    rows = events.groupBy(F.col("event_type").alias("harness"), F.col("user_id").alias("session")).agg(F.max("ts").alias("updated_at"), changed.alias("changed_at"))
    now = events.agg(F.max("ts")).first()[0]
    return drain.idle_asked(rows, now).select("harness", "session", F.unix_micros("updated_at").alias("updated"))


# dialect, the forms of path that are its logs
FORMS = ("p{s}/{d}.jsonl", "p{s}/chats/session-{d}.jsonl", "p{s}/chats/session-{d}.json", "{d}.jsonl", "p{s}/{d}/events.jsonl", "s{d}/events.jsonl", "2024/01/rollout-{d}.jsonl", "p{s}/.jsonl")
LOGS = [("session_log", 0), ("session_log", 5), ("rollout", 6), ("typed_events", 5), ("headed_messages", 0), ("headed_messages", 3), ("headed_messages", 5), ("replay", 1), ("replay", 2), ("chain", 1)]
_FORMS = ", ".join(f"({n}, '{f}')" for n, f in enumerate(FORMS))


@query(f"""WITH p AS (SELECT doc_id, n, replace(replace(form, '{{s}}', source), '{{d}}', doc_id::VARCHAR) AS path FROM documents CROSS JOIN (VALUES {_FORMS}) f(n, form) WHERE source IS NOT NULL AND NOT (n = 1 AND doc_id % 2 = 1))
  SELECT dialect, path FROM p JOIN (VALUES {", ".join(f"('{d}', {n})" for d, n in LOGS)}) l(dialect, n) USING (n)
  WHERE NOT (dialect = 'rollout' AND doc_id % 5 = 0) AND NOT (dialect = 'headed_messages' AND doc_id % 7 = 0 AND n = 0) AND NOT (dialect = 'replay' AND n = 2 AND doc_id % 2 = 0)""")
def q136_session_files(spark, d):
    number = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", "source", F.posexplode(F.array(*map(F.lit, FORMS))).alias("n", "form")).where("NOT (n = 1 AND doc_id % 2 = 1)")
    paths = docs.select("doc_id", "n", "source", F.replace(F.replace("form", F.lit("{s}"), F.col("source")), F.lit("{d}"), number).alias("path"))
    listed = paths.select(F.explode(F.array(*map(F.lit, files.PLACES))).alias("dialect"), "path", F.col("path").alias("place"))
    inner = F.when(F.col("doc_id") % 10 == 0, json_of(type="session_meta", payload={"thread_source": "subagent"})).when(F.col("doc_id") % 5 == 0, json_of(type="session_meta", payload={"source": {"subagent": {"of": number}}}))
    heads = paths.where("n = 6").select("path", F.coalesce(inner, json_of(type="session_meta", payload={"source": "cli"})).alias("first"))
    tag = F.when(F.col("doc_id") % 7 == 0, json_of(tags=[{"metadata": {"callingSessionId": number}}])).otherwise(json_of(tags=[{"metadata": {"other": number}}]))
    settings = paths.where("n = 0").select(F.regexp_replace("path", "jsonl$", "settings.json").alias("path"), tag.alias("text"))
    return files.session_files(listed, heads, settings).select("dialect", "path")
