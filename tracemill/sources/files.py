"""Which files are session logs: listings as tables, rules of each dialect as patterns of paths, and anti-joins for what only looks like one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.transcripts import _string, mended

# Where a dialect keeps its logs below its history, as paths from there.
PLACES = {
    "session_log": r"[^/]+/[^/]+\.jsonl",
    "rollout": r"(?:.*/)?rollout-[^/]*\.jsonl",
    "typed_events": r"[^/]+/events\.jsonl",
    "headed_messages": r"(?:[^/]+/)?[^/]+\.jsonl",
    "replay": r"[^/]+/chats/session-[^/]*\.jsonl?",
    "chain": r"[^/]+/chats/[^/]+\.jsonl",
}
INNER_THREADS = ("subagent", "memory_consolidation")


def listing(spark: SparkSession, dialect: str, history: str) -> DataFrame:
    """(dialect, path, place, changed_at, bytes) of every file below a dialect's history; place is the path from there. Contents are not read. Empty files, which hold no session, and hidden ones are not listed.

    A rollout history named sessions has a twin beside it, archived_sessions, which is listed with it where it is there.
    """
    folders = [history.rstrip("/")]
    if dialect == "rollout" and folders[0].rsplit("/", 1)[-1] == "sessions":
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders[0][: -len("sessions")] + "archived_sessions")
        if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            folders.append(jpath.toString())
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    place = F.col("path")
    for folder in folders:
        name = folder.split("://", 1)[-1]
        cut = F.instr("path", name + "/")
        place = F.when(cut > 0, F.substring(F.col("path"), cut + len(name) + 1, F.lit(2**30))).otherwise(place)
    return rows.select(F.lit(dialect).alias("dialect"), "path", place.alias("place"), F.col("modificationTime").alias("changed_at"), F.col("length").alias("bytes"))


def is_inner_rollout(first_line: Column) -> Column:
    """Whether a rollout log's first line says that another agent or the tool itself started it. False for null or no JSON."""
    j = F.try_parse_json(mended(first_line))
    has = lambda p: F.try_variant_get(j, p, "variant").isNotNull()
    inner = has("$.payload.source.subagent") | has("$.payload.source.internal") | F.coalesce(_string(j, "$.payload.thread_source").isin(*INNER_THREADS), F.lit(False))
    return F.coalesce((_string(j, "$.type") == "session_meta") & inner, F.lit(False))


def is_called(settings: Column) -> Column:
    """Whether the settings beside a log name the session that called it. False for null or no JSON."""
    tags = F.try_variant_get(F.try_parse_json(settings), "$.tags", "array<variant>")
    return F.coalesce(F.exists(tags, lambda t: F.try_variant_get(t, "$.metadata.callingSessionId", "variant").isNotNull()), F.lit(False))


def session_files(files: DataFrame, heads: DataFrame, settings: DataFrame) -> DataFrame:
    """The rows of files (dialect, path, place, more) that are session logs of their dialect.

    heads: path, first (a file's first line); settings: path, text of .settings.json files. Left out are logs of subagents, by the first line or by the settings beside them,
    and a replay's older .json where its .jsonl is there. A file without a row in heads or settings counts. Rows of an unknown dialect or null path are no logs.
    """
    is_log = F.lit(False)
    for dialect, place in PLACES.items():
        is_log = is_log | ((F.col("dialect") == dialect) & F.col("place").rlike(rf"\A(?:{place})\z"))
    logs = files.where(F.col("path").isNotNull() & is_log)
    inner = heads.where(is_inner_rollout(F.col("first"))).select(F.lit("rollout").alias("dialect"), "path")
    called = settings.where(F.col("path").endswith(".settings.json") & is_called(F.col("text")))
    called = called.select(F.lit("headed_messages").alias("dialect"), F.regexp_replace("path", r"\.settings\.json$", ".jsonl").alias("path"))
    newer = files.where((F.col("dialect") == "replay") & F.col("path").endswith(".jsonl")).select("dialect", F.regexp_replace("path", "l$", "").alias("path"))
    out = inner.unionByName(called).unionByName(newer).distinct()
    return logs.join(out, ["dialect", "path"], "left_anti").select(*(F.col(f"`{c}`") for c in files.columns))
