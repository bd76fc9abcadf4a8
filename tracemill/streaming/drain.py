"""Draining a queue of ingests as a stream: each batch is written under its number, so that a batch that runs again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.functions import fixed
from tracemill.streaming import ingest

DONE = "harness string, transcript string, ended boolean, queued long"
REFUSED = "harness string, transcript string, ended boolean, reason string, at timestamp"
Ingest = Callable[[DataFrame], DataFrame]


def sorted_out(queue: DataFrame, known: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(asked, refused) of a batch: one row a transcript that can be read, ended if any of its rows says so; the rest with a reason.

    queue: harness, transcript, ended, at; more columns are left out. A null harness or transcript, and an unknown harness, are refused row by row; a null ended is false.
    """
    rows = queue.select("harness", "transcript", F.coalesce("ended", F.lit(False)).alias("ended"), "at")
    reason = F.when(F.coalesce(F.trim("transcript"), F.lit("")) == "", "no transcript").when(~F.coalesce(F.col("harness").isin(*known), F.lit(False)), "unsupported harness")
    rows = rows.withColumn("reason", reason)
    return ingest.coalesced(rows.where("reason IS NULL"), "harness", "transcript"), rows.where("reason IS NOT NULL").select("harness", "transcript", "ended", "reason", "at")


def idle_asked(open_sessions: DataFrame, now, seconds: int = fixed.IDLE_SECONDS, most: int = 4, paused: bool = False) -> DataFrame:
    """Of each harness, the open sessions that a run also ends: unchanged for some time or their file gone, at most `most`, the longest unchanged first.

    open_sessions: harness, session, transcript, updated_at, changed_at (of the file; null if it is gone). None while capture is paused. The number is the
    feature (a run's share of old work); later runs take the rest. Sorting a harness's rows needs one task a harness only for the
    rows that are left of each part, since ranks are cut within parts first.
    """
    idle = F.col("changed_at").isNull() | (F.col("changed_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)))
    rows = open_sessions.where(F.lit(not paused) & idle).withColumn("__part", F.pmod(F.xxhash64("session"), F.lit(64)))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("updated_at", "session"))
    rows = rows.withColumn("__n", first("harness", "__part")).where(F.col("__n") <= most)
    return rows.withColumn("__n", first("harness")).where(F.col("__n") <= most).drop("__n", "__part")


def drained(queue: DataFrame, known: tuple[str, ...], work: Ingest, folder: str, checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Start draining a stream of queue rows with what is there now. work(asked) gives the rows to keep.

    Each batch goes to folder/done/batch=N, and what is refused to folder/refused/batch=N: a batch that is tried again after a crash overwrites its own rows, so
    each ingest counts once. A batch whose work fails more than `attempts` times in a row goes to refused whole, with the error as its reason, and
    doesn't stop the queue.
    """

    def batch(rows: DataFrame, number: int) -> None:
        asked, refused = sorted_out(rows, known)
        for left in range(attempts - 1, -1, -1):
            try:
                work(asked).write.mode("overwrite").parquet(f"{folder}/done/batch={number}")
                break
            except Exception as e:
                if left == 0:
                    asked.select("harness", "transcript", "ended").limit(0).write.mode("overwrite").parquet(f"{folder}/done/batch={number}")
                    failed = asked.select("harness", "transcript", "ended", F.lit(str(e)[:500]).alias("reason"), F.lit(None).cast("timestamp").alias("at"))
                    refused = refused.unionByName(failed)
        refused.write.mode("overwrite").parquet(f"{folder}/refused/batch={number}")

    return queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, folder: str, which: str, schema: str) -> DataFrame:
    """What batches left in folder: which is done or refused. An empty table where no batch ran."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{which}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
