"""Centroid clustering: k-means in exact integers, with partial-distance search for the nearest centroid.

Entries become integers floor(64 * x), so distances, sums and centroids are exact and no order of rows or tasks changes them.
A vector's squared differences are added up over the dimensions of highest variance first, some at a time. A centroid is
abandoned once its sum is strictly above the best whole distance known; those that survive are finished over all dimensions, and
of equal distances the smaller centroid number wins.

Each round reads the vectors once and sends a row of sums for each cluster and task; only centroids reach the driver. The last
assignment is a table, from which inertia is summed and rows are returned.

Cases: vectors that are null, of another length, or with null or non-finite entries are left out; a null id takes part, but
seeds come from it last; repeated rows each count, and seeds may then be equal (the smaller number gets all); with fewer vectors than
clusters there are as many centroids as vectors; an empty table gives an empty result; further columns are ignored.
Entries of 2 ** 20 and more are an error, as their distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import durable
from tracemill.llm.vectors import finite, grid, matrix

BITS = 26
ROWS = 2048  # vectors compared at once
STEP = 8  # dimensions added at once


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of the nearest centroid of each row of integers, by partial distances in this order of dimensions."""
    x, c = x[:, order], centroids[:, order]
    some = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(2)
    guess = some.argmin(1)
    best = ((x - c[guess]) ** 2).sum(1)
    row, at = np.nonzero(some <= best[:, None])
    some = some[row, at]
    for d in range(step, x.shape[1], step):
        some = some + ((x[row, d : d + step] - c[at, d : d + step]) ** 2).sum(1)
        stays = some <= best[row]
        row, at, some = row[stays], at[stays], some[stays]
    first = np.lexsort((at, some, row))
    first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
    return at[first], some[first]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, order: np.ndarray):
    """(ids, integers, cluster, distance) of a task's vectors, some rows at a time."""
    for batch in batches:
        rows, x = matrix(batch.column("__v"), centroids.shape[1])
        for a in range(0, len(rows), ROWS):
            own = grid(x[a : a + ROWS], BITS)
            yield batch.column("__id").take(pa.array(rows[a : a + ROWS])), own, *nearest(own, centroids, order)


def _spread(dims: int):
    """Sums and sums of squares of a task's vectors by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = np.floor(64 * matrix(batch.column("__v"), dims)[1])
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, n)), pa.array(np.arange(dims)), pa.array(s), pa.array(q)], ["n", "d", "s", "q"])

    return run


def _sums(centroids: np.ndarray, order: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x, cluster, _ in _assigned(batches, centroids, order):
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster).tolist():
                s[c] += x[cluster == c].sum(0)
        have = np.flatnonzero(n)
        if len(have):
            yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(n[have]), *(pa.array(s[have, d]) for d in range(dims))], ["c", "n", *(f"s{d}" for d in range(dims))])

    return run


def _last(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _assigned(batches, centroids, order):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["__id", "cluster", "distance"])

    return run


def seeds(rows: DataFrame, k: int, dims: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id, in that order, as integers; repeated ids by their entries."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")).cast("binary"), 256)
    found = rows.select(by.alias("h"), "__v").orderBy(F.col("h").asc_nulls_last(), "__v").limit(k).collect()  # k rows
    return grid(np.array([r["__v"] for r in found], float).reshape(len(found), dims), BITS)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """Per vector kept: id, cluster, distance (squared, in units of 1/64), cluster_inertia, inertia, centroid_sha256."""
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v"))
    rows = rows.where((F.size("__v") == dims) & finite(F.col("__v")))
    kind = dict(rows.dtypes)["__id"]
    centroids = seeds(rows, k, dims, seed)
    if not len(centroids):
        return rows.where("false").select(F.col("__id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))))
    spread = rows.select("__v").mapInArrow(_spread(dims), "n long, d long, s double, q double").groupBy("d").agg(*(F.sum(c).alias(c) for c in "nsq"))
    variance = np.zeros(dims)
    for r in spread.collect():  # a row for each dimension
        variance[r["d"]] = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
    order = np.argsort(-variance, kind="stable")
    schema = "c long, n long, " + ", ".join(f"s{d} long" for d in range(dims))
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(centroids, order), schema).groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(dims)))
        centroids = centroids.copy()
        for r in sums.collect():  # a row for each cluster
            centroids[r["c"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    done = durable(rows.mapInArrow(_last(centroids, order), f"__id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["i"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in inertia}
    own = [F.element_at(F.create_map(*(F.lit(x) for c, v in sorted(table.items()) for x in (c, v))), F.col("cluster")) for table in (inertia, digest)]
    return done.select(F.col("__id").alias(id_col), "cluster", "distance", own[0].cast("bigint").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), own[1].alias("centroid_sha256"))


def oracle_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """The same in DuckDB: every distance whole, one pair of tables a round."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) AS r, vec_id,
               list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
             FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS (SELECT r - 1 AS c, v FROM kept WHERE r <= {k})",
    ]
    dist = "list_sum(list_transform(list_zip(kept.v, m.v), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))"
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(CAST(d AS BIGINT)) AS d, min_by(c, (d, c)) AS c FROM
            (SELECT kept.r, kept.vec_id, kept.v, m.c, {dist} AS d FROM kept, c{i} AS m) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""n{i} AS (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY p) AS v FROM
                (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p) GROUP BY c)""")
            steps.append(f"c{i + 1} AS (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} AS o LEFT JOIN n{i} AS n ON n.c = o.c)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
          CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(list_transform(m.v, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
        FROM {last} AS a JOIN c{rounds} AS m ON m.c = a.c"""
