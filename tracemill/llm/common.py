"""What the training-data operators share: row identity, durable tables, and words as arrays.

Words are maximal runs of bytes outside ASCII white space (space, tab, LF, VT, FF, CR). UTF-8
never uses those bytes inside a character, so splitting bytes equals splitting characters.
Hashes are polynomial prefix sums modulo 2**64: one pass over a slice gives the hash of every
word, and one pass over the words gives the hash of every window of any length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.tables import CLEANUP, durable, scratch_dir

__all__ = ["CLEANUP", "Words", "durable", "fold", "free_name", "keyed", "labelled_sample", "labels_once", "mixed", "numbered", "powers", "scratch_dir", "slices", "sliding", "small_batches", "text_bytes"]

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "check": 0xAF251AF3B0F025B5}
_POWERS: dict[tuple[str, bool], np.ndarray] = {}


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under numbers, so that none of their names can clash or be read as a path, and the number of each name."""
    return df.toDF(*(f"c{n}" for n in range(len(df.columns)))), {c: f"c{n}" for n, c in enumerate(df.columns)}


def small_batches(spark: SparkSession, most: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, for tables of long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > most:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__k1, __k2, __id, __text): rows with equal id and text share a key and, having equal results, may."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.xxhash64(F.col(id_col), F.lit("|"), F.col(text_col)).alias("__k1"),
        F.hash(F.col(text_col), F.lit("|"), F.col(id_col)).alias("__k2"),
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
    )


def labels_once(labels: DataFrame, target: str, id_col: str = "doc_id") -> DataFrame:
    """One (id, label) row per document; null ids and labels go, the largest label of repeated rows stays."""
    return labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(target).cast("int").alias("__label"))


def fold(id_col) -> object:
    """crc32 of the id as text, modulo 3: fold 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __text, __label) of at most `most` labelled documents of each class outside fold 1, picked by hash.

    The bound is a parameter; the ids are chosen before any text is read, so one small broadcast join fetches the texts.
    Rows alike in id each count.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("__label", "__part").orderBy("__h", "__id"))
    parts = 16
    chosen = (
        labels_once(labels, target, id_col)
        .where(fold("__id") != 1)
        .withColumn("__h", F.xxhash64("__id", F.lit(17)))
        .withColumn("__part", F.pmod("__h", F.lit(parts)))
        .withColumn("__r", rank)
        .where(F.col("__r") <= -(-most // parts))
        .select("__id", "__label")
    )
    ids = {r[0]: r[1] for r in chosen.collect()}  # at most 2 * most + 32 ids
    kind = dict(chosen.dtypes)["__id"]
    small = docs.sparkSession.createDataFrame(list(ids.items()), f"__id {kind}, __label int")
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(small), "__id")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of whole texts with about `most` bytes; a longer text is a range of its own."""
    column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(len(column), max(end, start + 1))
        yield start, end
        start = end
    pa.default_memory_pool().release_unused()
    if _TRIM:  # what numpy has freed, too, so that workers which stay for the next stage don't keep it
        _TRIM(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and each text's offsets; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get((kind, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[kind], -1, 2**64) if inverse else _BASES[kind]
        seq = np.full(max(n, 1 << 16), base, np.uint64)
        seq[0] = 1
        have = np.cumprod(seq, dtype=np.uint64)
        if n <= 8 << 20:
            _POWERS[kind, inverse] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a slice of texts: byte bounds, text number and 64-bit hash of each."""

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True):
        data, offsets = text_bytes(column)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets, n = data, offsets, len(data)
        inside = ~_SEPARATOR[data]
        first = np.empty(n, bool)
        last = np.empty(n, bool)
        if n:
            first[0] = last[-1] = True
            np.logical_not(inside[:-1], out=first[1:])
            np.logical_not(inside[1:], out=last[:-1])
            edges = offsets[(offsets > 0) & (offsets < n)]
            first[edges] = True
            last[edges - 1] = True
        self.starts = np.flatnonzero(inside & first)
        self.ends = np.flatnonzero(inside & last) + 1
        self.doc = np.searchsorted(offsets[1:], self.starts, side="right")
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1) if len(self.starts) else np.zeros(len(offsets) - 1, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        if hashes:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[data] * powers("byte", n), out=sums[1:])
            self.hash = mixed((sums[self.ends] - sums[self.starts]) * powers("byte", n, True)[self.starts])

    def windows(self, length: int, kind: str = "word") -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of so many words at each word, and whether it lies within one text."""
        n = len(self.starts)
        m = max(n - length + 1, 0)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * powers(kind, n), out=sums[1:])
        out = mixed((sums[length : length + m] - sums[:m]) * powers(kind, m, True))
        return out, self.doc[:m] == self.doc[length - 1 : length - 1 + m]


def sliding(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The smallest (or what pick takes) of each `width` values in a row, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out
