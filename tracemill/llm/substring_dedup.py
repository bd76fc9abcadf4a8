"""Substring deduplication by level-wise doubling.

A window of `length` words that occurs twice or more goes, at every place. Windows are first
compared at about a quarter of that length; those repeated there are extended to twice the
length, and so on up to `length` itself, where every start left is compared.

At the lower levels not every window is compared but those that are the smallest by hash among
all that lie within some candidate of the full length. Equal candidates have equal smallest
windows, so none is lost, and a level moves about 2 / (length - level + 2) rows a word.

Texts are dealt by hash to blocks of some megabytes. A level moves a row for each distinct window
hash of a block, so that a passage that most documents share is one row a block, and gives each
block the hashes that occur twice; the block's texts then find the places themselves.

Cases: a null or empty text has no words and keeps none; texts shorter than `length` lose
nothing; repeated rows, alike in id and text, repeat each other's windows; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Words, durable, slices, sliding, small_batches

TOP = np.uint64(2**64 - 1)
BLOCK_BYTES = 16 << 20


def levels(length: int) -> list[int]:
    """The window lengths, each at most twice the one before: 35 gives 9, 18, 35."""
    out = [length]
    while out[0] > 9:
        out.insert(0, -(-out[0] // 2))
    return out


def _names(w: Words, level: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each window; below the last level that alone chooses candidates, there 16 bits more decide."""
    h, _ = w.windows(level)
    c = (w.windows(level, "check")[0] >> np.uint64(48)).astype(np.int32) if level == length else np.zeros(len(h), np.int32)
    return h, c


def _within(h: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which names are among the sorted ones of the block; among so few, 64 bits are enough."""
    if not len(alive):
        return np.zeros(len(h), bool)
    return alive[np.minimum(np.searchsorted(alive, h), len(alive) - 1)] == h


def _candidates(w: Words, length: int, level: int | None, alive: np.ndarray) -> np.ndarray:
    """Starts of full windows whose smallest window of length `level` is alive; all at first."""
    n = max(len(w.starts) - length + 1, 0)
    fits = w.doc[:n] == w.doc[length - 1 : length - 1 + n]
    if level is None or not n:
        return fits
    h, _ = w.windows(level)
    low = sliding(h, length - level + 1)[:n]
    seen, back = np.unique(low, return_inverse=True)
    return fits & _within(seen, alive)[back]


def _emit(w: Words, length: int, level: int, starts: np.ndarray) -> np.ndarray:
    """Words at which a window of length `level` stands for some candidate."""
    if level == length:
        return np.flatnonzero(starts)
    h, _ = w.windows(level)
    width = length - level + 1
    low = np.where(starts, sliding(h, width)[: len(starts)], np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    near = sliding(padded, width, np.maximum)[: len(h)]
    return np.flatnonzero((near == h) & (near > 0))


def _slices(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    text = part.column("__text").cast(pa.string())
    for a, b in slices(text):
        yield part.slice(a, b - a), Words(text.slice(a, b - a))


def _whole(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0] if len(table) else pa.RecordBatch.from_pylist([], table.schema)


def _alive(names: pa.Table) -> np.ndarray:
    return np.unique(np.asarray(_whole(names).column("__h")).view(np.uint64))


NAMES = "__h long, __c int, __block int, __n int"


def _seen(part: pa.RecordBatch, w: Words, length: int, level: int, before: int | None, alive: np.ndarray) -> pa.RecordBatch:
    """Rows (h, c, block, n): each distinct name of a slice and block, n is 2 where it is there more than once."""
    at = _emit(w, length, level, _candidates(w, length, before, alive))
    h, c = _names(w, level, length)
    h, c, block = h[at], c[at], np.asarray(part.column("__block"))[w.doc[at]]
    order = np.lexsort((h, block))
    h, c, block = h[order], c[order], block[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (block[1:] != block[:-1])
    n = np.diff(np.append(np.flatnonzero(new), len(h)))
    out = {"__h": h[new].view(np.int64), "__c": c[new], "__block": block[new].astype(np.int32), "__n": np.minimum(n, 2).astype(np.int32)}
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})


def _first_level(length: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for part, w in _slices(batch):
                yield _seen(part, w, length, level, None, none)

    return run


def _next_level(length: int, level: int, before: int):
    def run(texts: pa.Table, names: pa.Table) -> pa.Table:
        alive, out = _alive(names), []
        if len(alive) and len(texts):
            out = [_seen(part, w, length, level, before, alive) for part, w in _slices(_whole(texts))]
        kinds = pa.schema([("__h", pa.int64()), ("__c", pa.int32()), ("__block", pa.int32()), ("__n", pa.int32())])
        return pa.Table.from_batches(out, kinds)

    return run


def _digest(length: int, with_text: bool):
    def one(part: pa.RecordBatch, w: Words, alive: np.ndarray) -> pa.RecordBatch:
        h, _ = w.windows(length)
        at = np.flatnonzero(_within(h, alive) & _candidates(w, length, None, alive))
        edge = np.zeros(len(w.starts) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.bincount(w.doc[gone], minlength=len(part)).astype(np.int64)
        data, kept, sums = w.data.tobytes(), [], []
        for i in range(len(part)):
            words = data[w.offsets[i] : w.offsets[i + 1]].split()
            if removed[i]:
                words = [x for x, y in zip(words, gone[w.first[i] : w.first[i + 1]].tolist(), strict=True) if not y]
            text = b" ".join(words)
            sums.append(hashlib.sha256(text).hexdigest())
            kept.append(text if with_text else b"")
        columns = [part.column("__id"), pa.array(w.count.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums)]
        return pa.RecordBatch.from_arrays(columns, ["__id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    def run(texts: pa.Table, names: pa.Table) -> pa.Table:
        alive, kinds = _alive(names), [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())]
        out = [one(part, w, alive) for part, w in _slices(_whole(texts))] if len(texts) else []
        return pa.Table.from_batches(out, pa.schema([texts.schema.field("__id"), *kinds]))

    return run


def substring_dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, n_removed, kept_text (if texts), kept_sha256: texts without repeated windows of `length` words."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.lit("|"), F.col(text_col)), F.lit(blocks)).cast("int").alias("__block"),
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
    )
    by_block, alive, before = rows.groupBy("__block"), None, None
    for level in levels(length):
        if alive is None:
            seen = rows.mapInArrow(_first_level(length, level), NAMES)
        else:
            alive = durable(alive, f"windows{before}")
            seen = by_block.cogroup(alive.groupBy("__block")).applyInArrow(_next_level(length, level, before), NAMES)
        # a name has a row a block and slice at most, so the window over one is small and no join is needed
        total = F.sum("__n").over(Window.partitionBy("__h", "__c"))
        alive = seen.withColumn("__total", total).where("__total > 1").select("__block", "__h")
        before = level
    # the last level and the digest are one job, in which the texts are dealt to blocks once
    kind = dict(rows.dtypes)["__id"]
    out = by_block.cogroup(alive.groupBy("__block")).applyInArrow(_digest(length, texts), f"__id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.select(F.col("__id").alias(id_col), "n_words", "n_removed", *(["kept_text"] if texts else []), "kept_sha256")
