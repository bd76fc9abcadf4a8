"""Evidence and policy: Beta posteriors, exact comparisons, holdout rates, lifecycle and aging."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BLOCK = 1 << 16  # terms of a sum that are held at a time


def mean(s: Column, f: Column) -> Column:
    return (s + 1) / (s + f + 2)


def _sum_of_terms(first: float, steps: Callable[[np.ndarray], np.ndarray], n: int) -> float:
    """The sum of n terms: the logarithm of the first, and those of the steps from each to the next by number. Block by block, so that memory is bounded."""
    total, last = math.exp(first), first
    for a in range(0, n - 1, BLOCK):
        logs = last + np.cumsum(steps(np.arange(a, min(a + BLOCK, n - 1), dtype=float)))
        total, last = total + float(np.exp(logs).sum()), float(logs[-1])
    return total


def _sum_of_logs(a: float, b: float, n: int) -> float:
    """ln of a/b * (a+1)/(b+1) * ..., n factors."""
    total = 0.0
    for start in range(0, n, BLOCK):
        i = np.arange(start, min(start + BLOCK, n), dtype=float)
        total += float(np.log((a + i) / (b + i)).sum())
    return total


def _better(s: int, f: int, s2: int, f2: int) -> float:
    if s > s2:
        return 1 - _better(s2, f2, s, f)
    a, b, c, d = s + 1, f + 1, s2 + 1, f2 + 1
    # the terms are B(c+i, b+d) / ((b+i) B(1+i, b) B(c, d)); the first is a product of c or of b factors
    first = _sum_of_logs(d, b + d, c) if c <= b else _sum_of_logs(d, c + d, b)
    return _sum_of_terms(first, lambda i: np.log((c + i) * (b + i) / ((c + i + b + d) * (i + 1))), a)


def _below(s: int, f: int, rate: float) -> float:
    n = s + f + 1
    if not 0 < rate < 1:
        return float(rate >= 1)
    odds = (1 - rate) / rate
    return _sum_of_terms(n * math.log(rate), lambda i: np.log((n - i) / (i + 1) * odds), n - s)


def _by_row(of: Callable, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(x is None or x != x for x in row) else of(*row) for row in zip(*(c.tolist() for c in columns), strict=True)], dtype="float64")


def _prob_better(s: pd.Series, f: pd.Series, s2: pd.Series, f2: pd.Series) -> pd.Series:
    return _by_row(lambda *x: _better(*map(int, x)), s, f, s2, f2)


def _prob_below(s: pd.Series, f: pd.Series, rate: pd.Series) -> pd.Series:
    return _by_row(lambda s, f, rate: _below(int(s), int(f), rate), s, f, rate)


def prob_better(s: Column, f: Column, s2: Column, f2: Column) -> Column:
    """P(X > Y) for X ~ Beta(s+1, f+1), Y ~ Beta(s2+1, f2+1): an exact finite sum, in time linear in the counts; Arrow batches, numpy inside."""
    return pandas_udf(_prob_better, "double")(*(x.cast("bigint") for x in (s, f, s2, f2)))


def prob_below(s: Column, f: Column, rate: float) -> Column:
    """P(X < rate) for X ~ Beta(s+1, f+1), as a binomial tail; as above."""
    return pandas_udf(_prob_below, "double")(s.cast("bigint"), f.cast("bigint"), F.lit(float(rate)))


def harmful(s: Column, f: Column, hs: Column, hf: Column) -> Column:
    """At least five outcomes, and worse than the holdout (three or more of it), or than one half, with 95 %."""
    against = F.when(hs + hf >= 3, prob_better(hs, hf, s, f) >= 0.95).otherwise(prob_below(s, f, 0.5) >= 0.95)
    return (s + f >= 5) & against


def beats(s: Column, f: Column, s2: Column, f2: Column) -> Column:
    """At least three outcomes, a mean higher by 0.05, and better with 95 %."""
    return (s + f >= 3) & (mean(s, f) - mean(s2, f2) >= 0.05) & (prob_better(s, f, s2, f2) >= 0.95)


def established(s: Column, f: Column, hs: Column, hf: Column) -> Column:
    p = prob_better(s, f, hs, hf)
    return (hs + hf >= 50) | ((s + f >= 10) & (hs + hf >= 10) & ((p <= 0.05) | (p >= 0.95)))


def holdout_rate(configured: Column, is_established: Column) -> Column:
    clamped = F.least(F.greatest(configured, F.lit(0.0)), F.lit(1.0))
    return F.when(configured.isNotNull(), clamped).when(is_established, 0.02).otherwise(0.1)


def aged(state: Column, idle_days: Column) -> Column:
    """Serving states to archived after 90 idle days; active to stale after 30, and stale back to active before. Other states stay."""
    serving = state.isin("active", "stale", "candidate")
    return F.when(serving & (idle_days >= 90), "archived").when((state == "active") & (idle_days >= 30), "stale").when((state == "stale") & (idle_days < 30), "active").otherwise(state)
