"""A drained queue counts each ingest once, whatever crashes, and bad rows don't stop it."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tracemill.streaming import drain

KNOWN = ("a", "b")
QUEUE = "harness string, transcript string, ended boolean, at timestamp, extra int"
AT = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def _push(spark, folder, rows):
    spark.createDataFrame([(*r, AT, 1) for r in rows], QUEUE).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, tmp, work=lambda asked: asked, attempts=3):
    stream = spark.readStream.schema(QUEUE).parquet(f"{tmp}/queue")
    drain.drained(stream, KNOWN, work, f"{tmp}/out", f"{tmp}/checkpoint", attempts).awaitTermination()


def _kept(spark, tmp, which, schema):
    return sorted((r.batch, r.harness, r.transcript, r.ended, r[3]) for r in drain.kept(spark, f"{tmp}/out", which, schema).collect())


def test_batches(spark, tmp_path):
    assert drain.kept(spark, f"{tmp_path}/out", "done", drain.DONE).count() == 0
    _push(spark, f"{tmp_path}/queue", [("a", "/x", False), ("a", "/x", True), ("b", "/x", None), ("c", "/y", False), ("a", None, True), (None, "/z", True), ("a", " ", False)])
    _run(spark, tmp_path)
    _run(spark, tmp_path)  # nothing new
    assert _kept(spark, tmp_path, "done", drain.DONE) == [(0, "a", "/x", True, 2), (0, "b", "/x", False, 1)]
    refused = {(r.harness, r.transcript, r.reason) for r in drain.kept(spark, f"{tmp_path}/out", "refused", drain.REFUSED).collect()}
    assert refused == {("c", "/y", "unsupported harness"), ("a", None, "no transcript"), (None, "/z", "unsupported harness"), ("a", " ", "no transcript")}
    _push(spark, f"{tmp_path}/queue", [("a", "/x", False)])
    _run(spark, tmp_path)
    assert _kept(spark, tmp_path, "done", drain.DONE)[-1] == (1, "a", "/x", False, 1)


def test_killed_after_writing(spark, tmp_path):
    """A batch that wrote its rows and died before it was committed runs again and replaces them."""
    _push(spark, f"{tmp_path}/queue", [("a", f"/{n}", False) for n in range(20)])
    _run(spark, tmp_path)
    os.remove(f"{tmp_path}/checkpoint/commits/0")
    for name in os.listdir(f"{tmp_path}/checkpoint/commits"):
        if name.startswith(".0"):
            os.remove(f"{tmp_path}/checkpoint/commits/{name}")
    _run(spark, tmp_path)
    assert len(_kept(spark, tmp_path, "done", drain.DONE)) == 20


def test_poison(spark, tmp_path):
    """Work that fails now and then is tried again; work that always fails goes to refused, and the next batch runs."""
    tries = []

    def work(asked):
        tries.append(1)
        if len(tries) in (1, 2):
            raise ValueError("not yet")
        if asked.where("transcript = '/bad'").count():
            raise ValueError("broken")
        return asked

    _push(spark, f"{tmp_path}/queue", [("a", "/x", False)])
    _run(spark, tmp_path, work)
    assert len(tries) == 3 and len(_kept(spark, tmp_path, "done", drain.DONE)) == 1
    _push(spark, f"{tmp_path}/queue", [("a", "/bad", True)])
    _run(spark, tmp_path, work)
    _push(spark, f"{tmp_path}/queue", [("b", "/good", True)])
    _run(spark, tmp_path, work)
    assert [r[1:3] for r in _kept(spark, tmp_path, "done", drain.DONE)] == [("a", "/x"), ("b", "/good")]
    assert [r.reason for r in drain.kept(spark, f"{tmp_path}/out", "refused", drain.REFUSED).collect()] == ["broken"]


@pytest.mark.parametrize("paused", [False, True])
def test_idle(spark, paused):
    rows = [("a", f"s{n}", AT - dt.timedelta(hours=n), AT - dt.timedelta(minutes=n * 10)) for n in range(9)] + [("b", "gone", AT, None)]
    given = spark.createDataFrame(rows, "harness string, session string, updated_at timestamp, changed_at timestamp").withColumn("more", F.lit(1))
    got = {(r.harness, r.session) for r in drain.idle_asked(given, AT, paused=paused).collect()}
    assert got == (set() if paused else {("a", "s8"), ("a", "s7"), ("a", "s6"), ("a", "s5"), ("b", "gone")})
