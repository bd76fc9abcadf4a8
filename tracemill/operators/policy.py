"""Lifecycle decisions over revisions: quarantine, promotion, replacement, and the choice by Thompson sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracemill.operators import learning


def _draws(successes: pd.Series, failures: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([np.random.default_rng(int(x) & 0x7FFFFFFFFFFFFFFF).beta(s + 1, f + 1) for s, f, x in zip(successes, failures, seed, strict=True)])


def beta_draw(successes: Column, failures: Column, seed: Column) -> Column:
    """A draw from Beta(s+1, f+1), the same for the same seed; Arrow batches, numpy inside."""
    return pandas_udf(_draws, "double")(successes, failures, seed)


def chosen(revisions: DataFrame, query: str, key: str) -> DataFrame:
    """The servable revision of each query and procedure with the highest draw; seeded by query, procedure and revision."""
    draw = beta_draw(F.col("s"), F.col("f"), F.xxhash64(query, key, "revision"))
    w = Window.partitionBy(query, key).orderBy(F.desc("draw"), F.desc("revision"))
    return revisions.where(F.col("state").isin("active", "stale", "candidate")).withColumn("draw", draw).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def held_out(rows: DataFrame, rate: str, *keys: str) -> DataFrame:
    """Adds holdout: whether a seeded share of the rows withholds its procedure."""
    return rows.withColumn("holdout", F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < F.col(rate) * 1_000_000)


def settled(revisions: DataFrame, key: str) -> DataFrame:
    """Adds next_state. revisions: key, revision, state, s, f, hs, hf (holdout of the procedure).

    Harmful serving revisions are quarantined. Of the candidates left, the one with the best mean (of equal ones the latest)
    becomes active where there is no incumbent, or changes places with an incumbent that it beats.
    """
    harm = F.col("state").isin("active", "stale", "candidate") & learning.harmful(*map(F.col, ("s", "f", "hs", "hf")))
    rows = revisions.withColumn("__state", F.when(harm, "quarantined").otherwise(F.col("state")))
    own = Window.partitionBy(key)
    serving, waiting = F.col("__state").isin("active", "stale"), F.col("__state") == "candidate"
    rows = rows.withColumn("__inc", F.min(F.when(serving, F.struct("revision", "s", "f"))).over(own))
    rows = rows.withColumn("__best", F.max(F.when(waiting, F.struct(learning.mean(F.col("s"), F.col("f")).alias("mean"), "revision", "s", "f"))).over(own))
    none = F.col("__inc").isNull()
    better = F.coalesce(learning.beats(*(F.coalesce(F.col(c), F.lit(0)) for c in ("__best.s", "__best.f", "__inc.s", "__inc.f"))), F.lit(False)) & F.col("__best").isNotNull()
    up = waiting & (F.col("revision") == F.col("__best.revision")) & (none | better)
    down = serving & (F.col("revision") == F.col("__inc.revision")) & better
    return rows.withColumn("next_state", F.when(F.coalesce(up, F.lit(False)), "active").when(F.coalesce(down, F.lit(False)), "candidate").otherwise(F.col("__state"))).drop("__state", "__inc", "__best")
