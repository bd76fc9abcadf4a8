"""Embedding near-duplicates: vectors linked by a cosine of 0.9 or more, found by an inverted multi-index.

Vectors are scaled to length 1 and cut in halves. Each half has its own codebook (k-means on a bounded sample, see `sample`), and the two
codes of a vector are its cell in their product grid. A vector visits the cells nearest to it in the order of the multi-sequence
algorithm, that is by the sum of the squared distances of its halves to the two codes. How many cells it visits follows from a target recall: of
sampled vectors and partners turned away from them until the cosine is just the threshold, the wanted share must be found from one of
the two. Pairs nearer than that are found more surely. Codebooks grow with the root of the number of vectors, so that a cell holds
a few.

Exact copies are one node from the start and never expanded. A node goes once to its own row of the grid (the first code), and once to each row it
visits, with the second codes it wants there. Rows with many nodes are dealt to parts, members against visitors, so that a
group's size is bounded. There, whole vectors are compared in double precision, and what is linked goes on as a forest. Nodes
that links connect are a family. Then all pairs of a family are counted, in blocks of bounded size, so the numbers of links don't depend on
which pairs the index met. Two blocks whose centres and radii show that all or no pairs are linked are not compared.

Cases: a vector that is null, empty, zero, or holds null or non-finite entries is linked with nothing, and so are vectors of different
length; each length found has an index of its own; copies (equal vectors) are linked with each other, each repeated row counts; a null
id takes part, and a component's id is the smallest that is not null; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import durable
from tracemill.llm.components import components
from tracemill.llm.vectors import finite, matrix, unit

SAMPLE = 20_000
MOST_CODES = 4096
EACH_CELL = 4  # vectors, on average
MOST_MEMBERS, MOST_VISITORS = 4096, 32_768  # of a row's part
BLOCK = 2048  # nodes of a family compared at once
SURE = 1e-6  # of an angle, where rounding might matter


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k centres of the rows of x by k-means; a centre without rows stays where it is."""
    at = np.random.default_rng(seed).permutation(len(x))[:k]
    centres = x[at].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[i : i + 1024], centres).argmin(1) for i in range(0, len(x), 1024)])
        n = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        have = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[have], axis=0)
        centres[have] = sums / n[have][:, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the squared norm of x's rows."""
    return (centres * centres).sum(1)[None] - 2 * x @ centres.T


class MultiIndex:
    """Codebooks of the halves of unit vectors, and the number of cells that a vector visits."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, target: float, seed: int = 7):
        self.half = sample.shape[1] // 2
        k = min(MOST_CODES, len(sample), max(2, 1 << round(math.log2(max(4, n / EACH_CELL)) / 2)))
        self.books = [codebook(sample[:, : self.half], k, seed), codebook(sample[:, self.half :], k, seed + 1)]
        self.visits = self._fit(sample[:2000], threshold, target, seed)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])]

    def _fit(self, x: np.ndarray, threshold: float, target: float, seed: int) -> int:
        """Visits with which vectors at just the threshold are found from one side at least, as often as the target says."""
        if x.shape[1] < 2 or not target:
            return 1
        away = np.random.default_rng(seed + 2).normal(size=x.shape)
        away = unit(away - (away * x).sum(1)[:, None] * x)
        one, other = self.distances(x), self.distances(unit(threshold * x + math.sqrt(1 - threshold**2) * away))
        ranks = []
        for own, partner in ((one, other), (other, one)):
            at = [p.argmin(1) for p in partner]
            cell = own[0][np.arange(len(x)), at[0]] + own[1][np.arange(len(x)), at[1]]
            first, second = np.sort(own[0], 1), np.sort(own[1], 1)
            ranks.append([int(np.searchsorted(b, s - a).sum()) for a, b, s in zip(first, second, cell, strict=True)])
        return 1 + int(np.quantile(np.minimum(*ranks), target, method="higher"))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two codes of the cells that each row of x visits, nearest first.

        The cell of the r-th code of one half and the s-th of the other comes after r * s others, which bounds r and s.
        """
        k = len(self.books[0])
        most = min(self.visits, k)
        order, near = [], []
        for d in self.distances(x):
            some = np.argpartition(d, most - 1, axis=1)[:, :most]
            by = np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable")
            order.append(np.take_along_axis(some, by, 1))
            near.append(np.take_along_axis(d, order[-1], 1))
        r, s = np.array([(i, j) for i in range(most) for j in range(min(most, self.visits // (i + 1)))]).T
        sums = near[0][:, r] + near[1][:, s]
        best = np.argsort(sums, axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(order[0], r[best], 1), np.take_along_axis(order[1], s[best], 1)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of x and each of y, all of length 1, have at least this cosine; where rounding might decide, sums are exact."""
    cosine = x @ y.T
    out = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
        a, b = x[i].tolist(), y[j].tolist()
        dot, aa, bb = (math.fsum(p * q for p, q in zip(u, v, strict=True)) for u, v in ((a, b), (a, a), (b, b)))
        out[i, j] = dot / math.sqrt(aa * bb) >= threshold
    return out


class Forest:
    """Which of some nodes are connected; label is the smallest place among those connected."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.label[a], self.label[b]]), axis=1)
        up: dict[int, int] = {}

        def find(i: int) -> int:
            while (j := up.get(i, i)) != i:
                up[i] = i = up.get(j, j)
            return i

        for i, j in pairs[:, pairs[0] != pairs[1]].T.tolist():
            i, j = find(i), find(j)
            if i != j:
                up[max(i, j)] = min(i, j)
        if up:
            to = np.arange(len(self.label))
            to[list(up)] = [find(i) for i in list(up)]
            self.label = to[self.label]


def connect(forest: Forest, x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, most: int = 1024) -> None:
    """Joins all linked ones of the nodes a and b. Large sides meet some of b first, and what these connect isn't compared again."""
    if len(a) * len(b) <= 1 << 16:
        i, j = np.nonzero(linked(x[a], x[b], threshold))
        forest.join(a[i], b[j])
        return
    done = []
    for _ in range(4):
        rest = b[~np.isin(forest.label[b], forest.label[done])] if done else b
        if not len(rest):
            break
        done.append(rest[0])
        for side in (a, b):
            hit = side[linked(x[side], x[rest[:1]], threshold)[:, 0]]
            forest.join(hit, np.full(len(hit), rest[0]))
    for i in range(0, len(a), most):
        own = a[i : i + most]
        for group in np.unique(forest.label[own]).tolist():
            some, other = own[forest.label[own] == group], b[forest.label[b] != group]
            for j in range(0, len(other), most):
                p, q = np.nonzero(linked(x[some], x[other[j : j + most]], threshold))
                forest.join(some[p], other[j + q])


def _placed(index: MultiIndex, dims: int):
    """Each vector's cell, and the cells it visits by row of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                rows, cells = index.cells(unit(matrix(part.column("__v"), dims)[1]))
                home = rows[:, 0].copy(), cells[:, 0].copy()
                by = np.argsort(rows, axis=1, kind="stable")
                rows, cells = np.take_along_axis(rows, by, 1), np.take_along_axis(cells, by, 1)
                new = np.ones(rows.shape, bool)
                new[:, 1:] = rows[:, 1:] != rows[:, :-1]
                places = np.concatenate([np.flatnonzero(new), [new.size]])
                codes = pa.BinaryArray.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((2 * places).astype(np.int32)), pa.py_buffer(cells.astype("<u2"))])
                entries = pa.StructArray.from_arrays([pa.array(rows.ravel()[places[:-1]].astype(np.int32)), codes], ["row", "cells"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(1))]).astype(np.int32)), entries)
                yield pa.RecordBatch.from_arrays([part.column("__node"), part.column("__v"), pa.array(home[0].astype(np.int32)), pa.array(home[1].astype(np.int32)), lists], ["__node", "__v", "__row", "__cell", "__visits"])

    return run


def _met(dims: int, threshold: float):
    """Of a part of a row, members (with a cell) and visitors (with the cells they want): a forest of the links found."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, at = np.unique(np.asarray(table["__node"]), return_inverse=True)
        vectors = np.empty((len(nodes), dims))
        vectors[at] = unit(matrix(table["__v"].chunk(0), dims)[1])
        cell = np.asarray(table["__cell"].fill_null(-1))
        guest = cell < 0
        wants = table["__cells"].filter(pa.array(guest)).to_pylist()
        cells = np.frombuffer(b"".join(wants), "<u2").astype(np.int64)
        who = np.repeat(at[guest], [len(w) // 2 for w in wants])
        order, members = np.argsort(cells, kind="stable"), np.flatnonzero(~guest)
        cells, who = cells[order], who[order]
        members = members[np.argsort(cell[members], kind="stable")]
        forest = Forest(len(nodes))
        starts = np.flatnonzero(np.diff(cell[members], prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(members)], strict=True):
            i, j = np.searchsorted(cells, [cell[members[a]], cell[members[a]] + 1])
            connect(forest, vectors, who[i:j], at[members[a:b]], threshold)
        child = np.flatnonzero(forest.label != np.arange(len(nodes)))
        return pa.table({"a": nodes[child], "b": nodes[forest.label[child]]})

    return run


def found(nodes: DataFrame, dims: int, n: int, threshold: float, target: float, sample: int) -> DataFrame:
    """Links (a, b) between nodes of one length that connect those which the index meets, as a table."""
    spark = nodes.sparkSession
    chosen = nodes.select(F.xxhash64("__node", F.lit(3)).alias("h"), "__v").orderBy("h").limit(sample).toArrow()  # at most `sample` vectors
    index = MultiIndex(unit(matrix(chosen["__v"].combine_chunks(), dims)[1]), n, threshold, target)
    kind = dict(nodes.dtypes)["__v"]
    placed = durable(nodes.select("__node", "__v").mapInArrow(_placed(index, dims), f"__node long, __v {kind}, __row int, __cell int, __visits array<struct<row:int,cells:binary>>"), "placed")
    visits = placed.select("__node", "__v", F.explode("__visits").alias("x"))
    members = {r[0]: r[1] for r in placed.groupBy("__row").count().collect()}  # a row for each code
    visitors = {r[0]: r[1] for r in visits.groupBy("x.row").count().collect()}
    parts = [(row, -(-members[row] // MOST_MEMBERS), -(-visitors[row] // MOST_VISITORS)) for row in members]
    parts = F.broadcast(spark.createDataFrame(parts, "__row int, __m int, __n int"))  # at most MOST_CODES rows

    def dealt(many: str):
        return F.pmod(F.xxhash64("__node"), F.col(many)).cast("int")

    def all_of(many: str):
        return F.explode(F.sequence(F.lit(0), F.col(many) - 1))

    home = placed.join(parts, "__row").select("__row", dealt("__m").alias("__p"), all_of("__n").alias("__q"), "__node", "__v", "__cell", F.lit(None).cast("binary").alias("__cells"))
    guests = visits.select("__node", "__v", F.col("x.row").alias("__row"), F.col("x.cells").alias("__cells")).join(parts, "__row")
    guests = guests.select("__row", all_of("__m").alias("__p"), dealt("__n").alias("__q"), "__node", "__v", F.lit(None).cast("int").alias("__cell"), "__cells")
    return durable(home.unionByName(guests).groupBy("__row", "__p", "__q").applyInArrow(_met(dims, threshold), "a long, b long"), "links")


def _vectors(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of a column that all have one length."""
    return unit(matrix(column.take(pa.array(rows)), len(column[int(rows[0])]))[1])


def counts(x: np.ndarray, y: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of x the weights of the rows of y that it is linked with."""
    return np.concatenate([linked(x[i : i + 512], y, threshold) @ weight for i in range(0, len(x), 512)])


def _small(threshold: float):
    """Links of each node of families that come whole, one after another."""

    def total(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        family, copies, column = np.asarray(rows["__family"]), np.asarray(rows["__copies"]), rows["__v"].chunk(0)
        out = np.zeros(len(rows), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            x = _vectors(column, np.arange(a, b))
            out[a:b] = counts(x, x, copies[a:b], threshold)
        yield pa.RecordBatch.from_arrays([rows["__node"].chunk(0), pa.array(out)], ["__node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            family = np.asarray(held["__family"])
            whole = int(np.searchsorted(family, family[-1])) if len(family) else 0  # sorted: the last may go on
            if whole:
                yield from total(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from total(held)

    return run


def _summary(table: pa.Table) -> pa.Table:
    """A block's centre, the largest angle to it, and its copies."""
    table = table.combine_chunks()
    x = _vectors(table["__v"].chunk(0), np.arange(len(table)))
    centre = unit(x.sum(0)[None])[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    first = {c: [table[c][0].as_py()] for c in ("__family", "__block")}
    return pa.table({**first, "__centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "__radius": [radius], "__sum": [sum(table["__copies"].to_pylist())]})


def _decided(threshold: float):
    """Of two blocks: 1 if all pairs are linked, 0 if they must be compared; the others go."""
    most = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_lists(batch.column(f"__centre_{s}")) for s in "lr")
            angle = np.array([math.acos(min(1.0, max(-1.0, float(p @ q)))) for p, q in zip(a, b, strict=True)])
            same = np.asarray(batch.column("__l")) == np.asarray(batch.column("__r"))
            wide = np.asarray(batch.column("__radius_l")) + np.asarray(batch.column("__radius_r"))
            every = np.where(same, wide, angle + wide) <= most - SURE
            none = ~same & (angle - wide > most + SURE)
            names = ["__family", "__l", "__r", "__sum_l", "__sum_r"]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(every)], [*names, "__every"])
            yield out.filter(pa.array(~none))

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in column]


def _compared(threshold: float):
    """Links of each node of two blocks (sides 0 and 1), or of one with itself (side 0 only)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, copies, column = np.asarray(table["__side"]), np.asarray(table["__copies"]), table["__v"].chunk(0)
        at = [np.flatnonzero(side == s) for s in (0, 1)]
        x = [_vectors(column, r) if len(r) else None for r in at]
        if x[1] is None:
            n, rows = counts(x[0], x[0], copies[at[0]], threshold), at[0]
        else:
            n = np.concatenate([counts(x[0], x[1], copies[at[1]], threshold), counts(x[1], x[0], copies[at[0]], threshold)])
            rows = np.concatenate(at)
        return pa.table({"__node": table["__node"].take(pa.array(rows)), "n": n})

    return run


def family_links(own: DataFrame, threshold: float) -> DataFrame:
    """(__node, n): how many vectors of its family a node is linked with, all copies and itself counted. own: a table with __blocks and __block."""
    few = own.where("__blocks = 1").repartition("__family").sortWithinPartitions("__family").select("__family", "__node", "__copies", "__v").mapInArrow(_small(threshold), "__node long, n long")
    many = own.where("__blocks > 1").select("__family", "__block", "__node", "__copies", "__v")
    blocks = durable(many.groupBy("__family", "__block").applyInArrow(_summary, "__family long, __block long, __centre array<double>, __radius double, __sum long"), "blocks")
    left, right = (blocks.select("__family", F.col("__block").alias(f"__{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("__centre", "__radius", "__sum"))) for s in "lr")
    pairs = left.join(right, "__family").where("__l <= __r")
    pairs = durable(pairs.mapInArrow(_decided(threshold), "__family long, __l long, __r long, __sum_l long, __sum_r long, __every boolean"), "pairs")
    sure = pairs.where("__every")
    sure = sure.select("__family", F.col("__l").alias("__block"), F.col("__sum_r").alias("n")).unionByName(sure.where("__l < __r").select("__family", F.col("__r").alias("__block"), F.col("__sum_l").alias("n")))
    sure = many.select("__family", "__block", "__node").join(sure.groupBy("__family", "__block").agg(F.sum("n").alias("n")), ["__family", "__block"]).select("__node", "n")
    open_ = pairs.where("NOT __every").select("__family", "__l", "__r")
    sides = [many.join(open_.where(which).withColumn("__block", F.col(c)), ["__family", "__block"]).select("__family", "__l", "__r", F.lit(s).alias("__side"), "__node", "__copies", "__v") for s, c, which in ((0, "__l", "true"), (1, "__r", "__l < __r"))]
    compared = sides[0].unionByName(sides[1]).groupBy("__family", "__l", "__r").applyInArrow(_compared(threshold), "__node long, n long")
    return few.unionByName(sure).unionByName(compared).groupBy("__node").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, target: float = 0.98, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (smallest id reachable by links), kept (whether that is its own)."""
    rows = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v"))
    some = finite(F.col("__v")) & F.exists("__v", lambda x: x != 0)
    rows = rows.select("__id", F.when(some, F.col("__v")).alias("__v"))
    named = rows.select("__id", "__v", F.when(F.col("__v").isNotNull(), F.xxhash64("__v")).alias("__k1"), F.xxhash64(F.lit(5), "__v").alias("__k2"))
    copies = named.where("__k1 IS NOT NULL").groupBy("__k1", "__k2").agg(F.first("__v").alias("__v"), F.count("*").alias("__copies"), F.min("__id").alias("__least"))
    nodes = durable(copies.withColumn("__node", F.monotonically_increasing_id()), "nodes")
    lengths = {r[0]: r[1] for r in nodes.groupBy(F.size("__v")).count().where("count > 1").collect()}  # a row for each length
    links = [found(nodes.where(F.size("__v") == dims), dims, n, threshold, target, sample) for dims, n in sorted(lengths.items())]
    if links:
        tree = components(functools.reduce(DataFrame.unionByName, links)).select(F.col("a").alias("__node"), F.col("b").alias("__family"))
        family = durable(tree.unionByName(tree.select(F.col("__family").alias("__node"), "__family").distinct()), "families")
        own = nodes.join(family, "__node")
        sizes = own.groupBy("__family").agg(F.ceil(F.count("*") / BLOCK).alias("__blocks"), F.min("__least").alias("component_id"))
        own = own.join(sizes, "__family").withColumn("__block", F.pmod(F.xxhash64("__node"), F.col("__blocks")))
        own = durable(own, "members")
        near = family_links(own, threshold).join(own.select("__node", "__k1", "__k2", "component_id"), "__node").select("__k1", "__k2", (F.col("n") - 1).alias("n_links"), "component_id")
        alone = nodes.where("__copies > 1").join(own.select("__node"), "__node", "left_anti")
    else:
        alone = nodes.where("__copies > 1")
        near = alone.limit(0).select("__k1", "__k2", F.lit(0).cast("bigint").alias("n_links"), F.col("__least").alias("component_id"))
    near = near.unionByName(alone.select("__k1", "__k2", (F.col("__copies") - 1).alias("n_links"), F.col("__least").alias("component_id")))
    found_ = F.col("n_links").isNotNull()
    out = named.select("__id", "__k1", "__k2").join(near, ["__k1", "__k2"], "left")
    component = F.when(found_, F.col("component_id")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))


def oracle_sql(threshold: float = 0.9) -> str:
    """All pairs in DuckDB, then the smallest id reachable."""
    return f"""WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good AS x, good AS y
            WHERE x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, CASE WHEN len(x.v) = len(y.v) THEN y.v ELSE x.v END) >= {threshold}),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""
