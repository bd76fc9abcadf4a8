"""The nearest vectors of each query by sign codes, compared block by block in numpy: no pair leaves its task but the nearest few."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTORS, QUERIES = 1 << 14, 1 << 12  # of one group in one part and in one chunk
COMPARED, ASKED = 1 << 15, 64  # of a part's vectors and of a chunk's queries at a time
CELL = ("group", "part", "chunk")


def _shares(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(group, name): how many shares of `most` rows a group has, where that is more than one. At most a row for each `most` rows, so it is broadcast."""
    return F.broadcast(rows.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1))


def nearest_codes(index: DataFrame, queries: DataFrame, most: int, parts: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, cosine, not rounded) of the `most` vectors by (distance, vec_id) for each query in each part of its group.

    index: vec_id, group, code, z; queries: query_id, group, code, embedding. Vectors of a large group are dealt to parts (to `parts`, if given, in
    every group) and its queries to chunks; each part meets each chunk in one task, which holds a part and streams the queries.
    """
    index, queries = index.where("group IS NOT NULL"), queries.where("group IS NOT NULL")
    sizes = (_shares(index, VECTORS, "__parts"), _shares(queries, QUERIES, "__chunks"))
    shares = lambda rows: rows.join(sizes[0], "group", "left").join(sizes[1], "group", "left")
    n_parts = F.lit(parts) if parts else F.coalesce("__parts", F.lit(1))
    n_chunks = F.coalesce("__chunks", F.lit(1))
    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kinds = {"vec_id": index.schema["vec_id"].dataType, "query_id": queries.schema["query_id"].dataType, "q": index.select("z.q").schema["q"].dataType, "x": queries.schema["embedding"].dataType}
    none: Callable[[str], Column] = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    vectors = shares(index).select("group", own("vec_id", n_parts).alias("part"), every(n_chunks).alias("chunk"), F.lit(0).alias("kind"), "vec_id", none("query_id"), "code", F.col("z.scale").alias("scale"), F.col("z.q").alias("q"), none("x"))
    asked = shares(queries).select("group", every(n_parts).alias("part"), own("query_id", n_chunks).alias("chunk"), F.lit(1).alias("kind"), none("vec_id"), "query_id", "code", F.lit(None).cast("double").alias("scale"), none("q"), F.col("embedding").alias("x"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = vectors.unionByName(asked).repartition(n, *CELL).sortWithinPartitions(*CELL, "kind", "vec_id")
    ids = ", ".join(f"{name} {kinds[name].simpleString()}" for name in ("query_id", "vec_id"))
    return cells.mapInArrow(_met(most), f"{ids}, distance int, cosine double")


def _met(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, vectors, block = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*CELL, "kind")), strict=True))
            for (*at, kind), rows in groupby(range(len(keys)), keys.__getitem__):
                rows = list(rows)
                own = batch.slice(rows[0], len(rows))
                if at != cell:
                    cell, vectors, block = at, [], None
                if kind == 0:
                    vectors.append(own)
                elif vectors:
                    block = block or _Block(vectors)
                    for a in range(0, own.num_rows, ASKED):
                        yield block.nearest(own.slice(a, ASKED), most)

    return run


def _codes(column: pa.Array) -> np.ndarray:
    """Sign codes, two words of 32 bits in one of 64."""
    words = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(len(column), -1)
    words = np.pad(words, ((0, 0), (0, words.shape[1] % 2)))
    return words[:, ::2] | words[:, 1::2] << np.uint64(32)


class _Lists:
    """Lists of numbers as the rows of a matrix; those that are null, hold null or are not as long as the longest are not plain."""

    def __init__(self, column: pa.Array):
        self.column = column
        flat, lengths = column.flatten(), column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        width = max(int(lengths.max(initial=0)), 0)
        holds = np.zeros(len(column), bool)
        if flat.null_count:
            starts = np.repeat(np.arange(len(column)), np.maximum(lengths, 0))
            holds[starts[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        self.plain = (lengths == width) & ~holds
        values = flat.fill_null(0).to_numpy(zero_copy_only=False)
        self.matrix = np.zeros((len(column), width), values.dtype)
        self.matrix[self.plain] = values[np.repeat(self.plain, np.maximum(lengths, 0))].reshape(-1, width)


class _Block:
    """A part's vectors, in the order of their ids."""

    def __init__(self, batches: list[pa.RecordBatch]):
        column = lambda name: pa.concat_arrays([b.column(name) for b in batches])
        self.ids, self.codes, self.lists = column("vec_id"), _codes(column("code")), _Lists(column("q"))
        scale = column("scale")
        self.scale, self.scaled = scale.fill_null(0.0).to_numpy(zero_copy_only=False), scale.is_valid().to_numpy(zero_copy_only=False)

    def nearest(self, asked: pa.RecordBatch, most: int) -> pa.RecordBatch:
        codes, best = _codes(asked.column("code")), None
        for a in range(0, len(self.ids), COMPARED):
            block = self.codes[a : a + COMPARED]
            distance = sum(np.bitwise_count(codes[:, w, None] ^ block[None, :, w]).astype(np.int32) for w in range(codes.shape[1]))
            found = _least(distance * np.int32(len(block)) + np.arange(len(block), dtype=np.int32), most).astype(np.int64)
            found = (found // len(block) << 32) + found % len(block) + a
            best = found if best is None else _least(np.concatenate([best, found], 1), most)
        at, row = best & 0xFFFFFFFF, np.repeat(np.arange(len(best)), best.shape[1])
        cosine = self._cosines(asked.column("x"), at)
        return pa.RecordBatch.from_arrays([asked.column("query_id").take(pa.array(row)), self.ids.take(pa.array(at.ravel())), pa.array((best >> 32).ravel().astype(np.int32)), cosine], ["query_id", "vec_id", "distance", "cosine"])

    def _cosines(self, x: pa.Array, at: np.ndarray) -> pa.Array:
        """Products are added in the order of the components, as a fold does; null where a list is null, holds null or both differ in length."""
        lists, asked = self.lists, _Lists(x)
        plain, total = lists.plain[at] & asked.plain[:, None] & self.scaled[at], np.zeros(at.shape)
        if lists.matrix.shape[1] == asked.matrix.shape[1]:
            z, y = lists.matrix[at], asked.matrix.astype(np.float64)
            for j in range(y.shape[1]):
                total += z[:, :, j] * y[:, None, j]
        else:
            plain[:] = False
        total, known = total * self.scale[at], plain.copy()
        for i, k in zip(*np.nonzero(~plain & self.scaled[at]), strict=True):
            one, other = lists.column[int(at[i, k])].as_py(), x[int(i)].as_py()
            if one is not None and other is not None and len(one) == len(other) and None not in one and None not in other:
                added = 0.0
                for p, q in zip(one, other, strict=True):
                    added += p * q
                total[i, k], known[i, k] = added * self.scale[at[i, k]], True
        return pa.array(total.ravel(), mask=~known.ravel())


def _least(keys: np.ndarray, most: int) -> np.ndarray:
    """The least `most` of each row."""
    return np.partition(keys, most - 1, axis=1)[:, :most] if keys.shape[1] > most else keys
