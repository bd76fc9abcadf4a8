import json
import os

from tracemill.sources import transcripts
from tracemill.streaming import ingest


def test_idle_sessions_close(spark, tmp_path):
    source, ck = tmp_path / "in", tmp_path / "ck"
    source.mkdir()
    at = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    row = lambda s, m, kind, action=None: {"at": at(m), "session": s, "cwd": "/", "type": kind, "action": action}
    batches = [[row("a", 0, "prompt"), row("a", 5, "call", "edit"), row("b", 1, "prompt")], [row("a", 50, "prompt"), row("b", 10, "call", "run")], [row("c", 300, "prompt")], [row("c", 301, "call", "edit")]]
    for n, batch in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, batch)))
        os.utime(source / f"{n}.json", (1_700_000_000 + 60 * n, 1_700_000_000 + 60 * n))
    stream = spark.readStream.schema(transcripts.JOURNAL).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(source))
    closed = ingest.close_sessions(transcripts.journal(stream))
    q = closed.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(ck)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["session"], r["prompts"], r["calls"], r["edits"], r["reason"]) for r in spark.table("closed").collect())
    assert got == [("a", 1, 0, 0, "idle"), ("a", 1, 1, 1, "resumed"), ("b", 1, 1, 0, "idle")]


def test_progress_and_queue(spark):
    events = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "session string, seq int")
    progress = spark.createDataFrame([("a", 1, False)], "session string, extracted_through int, ended boolean")
    assert sorted(map(tuple, ingest.new_events(events, progress).collect())) == [("a", 2), ("b", 1)]
    seen = spark.createDataFrame([("a", 2, True), ("b", 1, False)], progress.schema)
    assert sorted(map(tuple, ingest.advanced(progress, seen).collect())) == [("a", 2, True), ("b", 1, False)]
    queue = spark.createDataFrame([("x", "t", False), ("x", "t", True), ("y", "t", False)], "harness string, transcript string, ended boolean")
    assert sorted(map(tuple, ingest.coalesced(queue, "harness", "transcript").collect())) == [("x", "t", True, 2), ("y", "t", False, 1)]
