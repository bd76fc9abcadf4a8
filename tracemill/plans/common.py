"""Reading the test tables in their roles, and registering queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import sessions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, at, type, value, props): users as sessions, numbered by time."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("type"), "value", "props")
    return sessions.numbered(rows, "session", "at", "event_id")


EVENTS = """ev AS (SELECT user_id AS session, ts AS moment, event_id, event_type AS type, value, props,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""


def json_of(**fields) -> Column:
    """An object as JSON text; Column values are texts or numbers, dicts and lists nest."""

    def of(x) -> Column:
        if isinstance(x, Column):
            return x
        if isinstance(x, dict):
            return F.struct(*(of(v).alias(k) for k, v in x.items()))
        if isinstance(x, list):
            return F.array(*map(of, x))
        return F.lit(x)

    return F.to_json(F.struct(*(of(v).alias(k) for k, v in fields.items())))


def registrar():
    """A decorator @query(sql) and the two tables it fills."""
    queries, oracle = {}, {}

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query, queries, oracle
