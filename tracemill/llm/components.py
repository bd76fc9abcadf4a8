"""Connected components of an edge table by alternating star steps; nothing but counts reaches the driver.

Tasks first reduce the edges they hold to forests. A node with very many edges (the centre of a large star) is
looked up by broadcast, of at most MOST_HOT such nodes, so that no task gets all its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import durable

HELD = 500_000
MOST_HOT = 10_000
LEAST_HOT = 1000


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each node of some edges but the smallest of its component, with that node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    root = np.array([find(i) for i in range(len(nodes))], np.int64)
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], ["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append([np.asarray(batch.column(c)) for c in "ab"])
        size += len(batch)
        if size > HELD:
            yield _forest(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield _forest(*map(np.concatenate, zip(*held, strict=True)))


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m): edges with the smallest b of their a. The smallest ones are a table, as the plan names them more than once."""
    hot = max(LEAST_HOT, 2 * total // MOST_HOT)
    least = durable(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), "least")
    many = least.where(F.col("c") >= hot).select("a", F.col("m").alias("__m"))
    marked = edges.join(F.broadcast(many), "a", "left")
    rest = marked.where("__m IS NULL").drop("__m").join(least.where(F.col("c") < hot).select("a", "m"), "a")
    return rest.unionByName(marked.where("__m IS NOT NULL").withColumnRenamed("__m", "m"))


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return _with_least(both, total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    moved = _with_least(edges, total)
    return moved.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of an edge table (a, b) but the smallest of its component, with that smallest node.

    Each step's edges are a table in the shared folder, so that plans stay small on the driver: one plan for a whole round would
    name its edges a hundred times. The rounds needed grow with the logarithm of the nodes. Self-loops and repeated edges
    don't matter; a table without edges gives none.
    """
    now = durable(edges.where("a <> b").mapInArrow(_forests, "a long, b long").distinct(), "forest")
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            return now
        before = state
        now = durable(_small(durable(_large(now, state[0]), "large"), state[0]), "star")
