"""A folder of each dialect: what counts as a session log."""

import json

from pyspark.sql import functions as F

from tracemill.sources import files, transcripts

INNER = {"type": "session_meta", "payload": {"source": {"subagent": "review"}}}
OWN = {"type": "session_meta", "payload": {"source": "cli", "thread_source": "user"}}
CALLED = {"tags": [{"name": "x"}, {"metadata": {"callingSessionId": "1"}}]}
FOLDERS = {
    "session_log": ({"p/a.jsonl": "x", "p/a.txt": "x", "b.jsonl": "x", "p/q/c.jsonl": "x", "p/.jsonl": "x"}, ["p/a.jsonl"]),
    "rollout": ({"2024/rollout-1.jsonl": OWN, "rollout-2.jsonl": INNER, "2024/other.jsonl": OWN, "rollout-3.jsonl": {"type": "turn", "payload": INNER["payload"]}, "rollout-4.jsonl": "no JSON", "rollout-5.jsonl": {"type": "session_meta", "payload": {"thread_source": "memory_consolidation"}}, "rollout-6.jsonl": ""}, ["2024/rollout-1.jsonl", "rollout-3.jsonl", "rollout-4.jsonl"]),
    "typed_events": ({"s/events.jsonl": "x", "events.jsonl": "x", "s/t/events.jsonl": "x", "s/more.jsonl": "x"}, ["s/events.jsonl"]),
    "headed_messages": ({"a.jsonl": "x", "p/b.jsonl": "x", "p/b.settings.json": CALLED, "p/c.jsonl": "x", "p/c.settings.json": {"tags": "none"}, "p/q/d.jsonl": "x", "p/e.jsonl": "x", "p/e.settings.json": "{"}, ["a.jsonl", "p/c.jsonl", "p/e.jsonl"]),
    "replay": ({"p/chats/session-1.jsonl": "x", "p/chats/session-1.json": "x", "p/chats/session-2.json": "x", "p/chats/1.jsonl": "x", "p/session-3.jsonl": "x"}, ["p/chats/session-1.jsonl", "p/chats/session-2.json"]),
    "chain": ({"p/chats/a.jsonl": "x", "p/chats/a.json": "x", "p/a.jsonl": "x"}, ["p/chats/a.jsonl"]),
}


def test_folders(spark, tmp_path):
    for dialect, (given, want) in FOLDERS.items():
        history = tmp_path / dialect
        for name, content in given.items():
            (history / name).parent.mkdir(parents=True, exist_ok=True)
            (history / name).write_text(content if isinstance(content, str) else json.dumps(content) + "\nmore\n")
        listed = files.listing(spark, dialect, str(history))
        lines = transcripts.read_lines(spark, str(history))
        heads = lines.where("line = 1").select(F.col("file").alias("path"), F.col("value").alias("first"))
        scheme = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
        settings = scheme(spark.read.text(str(history), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
        found = files.session_files(scheme(listed), scheme(heads), settings)
        assert sorted(r.place for r in found.collect()) == want, dialect
        assert found.columns == ["dialect", "path", "place", "changed_at", "bytes"]


def test_archive(spark, tmp_path):
    for name in ("sessions/2024/rollout-1.jsonl", "archived_sessions/rollout-2.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.place for r in files.listing(spark, "rollout", f"{tmp_path}/sessions/").collect()) == ["2024/rollout-1.jsonl", "rollout-2.jsonl"]


def test_odd_rows(spark):
    rows = [("rollout", None, None, 1), ("unknown", "/p/a.jsonl", "p/a.jsonl", 1), (None, "/p/a.jsonl", "p/a.jsonl", 1), ("session_log", "/p/a.jsonl", "p/a.jsonl", 1), ("session_log", "/p/a.jsonl", "p/a.jsonl", 1)]
    listed = spark.createDataFrame(rows, "dialect string, path string, place string, `a.b` int")
    none = spark.createDataFrame([(None, None)], "path string, first string")
    found = files.session_files(listed, none, none.withColumnRenamed("first", "text"))
    assert [r["a.b"] for r in found.collect()] == [1, 1] and found.columns == listed.columns
    assert files.session_files(listed.limit(0), none, none.withColumnRenamed("first", "text")).count() == 0
