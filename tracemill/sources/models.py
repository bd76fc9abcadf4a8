"""Model files as sources: a matrix of token vectors read in parts by byte range, and a tokenizer's vocabulary.

    spark.dataSource.register(models.TokenVectors)
    spark.read.format("token_vectors").load(".../model.safetensors")      # token, scale, q

The file's header (at most 100 MB, by its format) is read on the driver, rows only in tasks, each its own range. Paths may be local or of
any file system that Arrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "token int, scale float, q array<tinyint>"
ARROW = pa.schema([("token", pa.int32()), ("scale", pa.float32()), ("q", pa.list_(pa.int8()))])
MOST_HEADER, MOST_VOCABULARY, BATCH = 100_000_000, 5_000_000, 4096
# The tensor's name and the types of its numbers in the file, little-endian.
TENSOR = "embeddings"
TYPES = {"F16": "<f2", "F32": "<f4"}


@dataclass
class Matrix:
    """Where a matrix stands in a file."""

    start: int
    rows: int
    dims: int
    kind: str

    @property
    def row_bytes(self) -> int:
        return self.dims * np.dtype(self.kind).itemsize


@dataclass
class Rows(InputPartition):
    first: int
    last: int


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(name)


def matrix(path: str, tensor: str = TENSOR) -> Matrix:
    """The header's word on a matrix. ValueError if there is none, or if its sizes contradict each other or the file's."""
    with _opened(path) as file:
        size = file.size()
        length = int.from_bytes(file.read(8), "little")
        if size < 8 or length > min(MOST_HEADER, size - 8):
            raise ValueError(f"{path}: no header")
        try:
            found = json.loads(file.read(length))[tensor]
            kind, (rows, dims), (begin, end) = found["dtype"], found["shape"], found["data_offsets"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"{path}: no matrix {tensor}: {e}") from e
    if kind not in TYPES:
        raise ValueError(f"{path}: numbers of type {kind} can't be read")
    out = Matrix(8 + length + begin, rows, dims, TYPES[kind])
    if end - begin != rows * out.row_bytes or 8 + length + end > size:
        raise ValueError(f"{path}: {tensor} has the wrong size")
    return out


def quantized(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, q) of rows: the largest size of a row becomes 127, halves are rounded away from zero; a row of zeros has scale 1."""
    values = values.astype("f4")
    largest = np.abs(values).max(axis=1, initial=0.0)
    scale = np.where(largest > 0, largest / np.float32(127), np.float32(1)).astype("f4")
    exact = (values / scale[:, None]).astype("f8")
    return scale, np.clip(np.trunc(exact + np.copysign(0.5, exact)), -127, 127).astype("i1")


class VectorReader(DataSourceReader):
    def __init__(self, path: str, tensor: str, rows_each: int):
        self.path, self.rows_each = path, rows_each
        self.matrix = matrix(path, tensor)

    def partitions(self) -> list[Rows]:
        return [Rows(n, min(n + self.rows_each, self.matrix.rows)) for n in range(0, self.matrix.rows, self.rows_each)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        m = self.matrix
        with _opened(self.path) as file:
            for first in range(partition.first, partition.last, BATCH):
                count = min(BATCH, partition.last - first)
                data = file.read_at(count * m.row_bytes, m.start + first * m.row_bytes)
                scale, q = quantized(np.frombuffer(data, m.kind).reshape(count, m.dims))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype="i4") * m.dims), pa.array(q.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count, dtype="i4")), pa.array(scale), lists], schema=ARROW)


class TokenVectors(DataSource):
    """Token vectors as eight-bit numbers with a scale. Options: path, tensor ("embeddings"), rows (of one partition; 65536)."""

    @classmethod
    def name(cls) -> str:
        return "token_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"], self.options.get("tensor", TENSOR), int(self.options.get("rows", 65536)))


def token_vectors(spark: SparkSession, path: str, **options) -> DataFrame:
    """(token, scale, q) of a model file, a row for each row of its matrix."""
    spark.dataSource.register(TokenVectors)
    return spark.read.format("token_vectors").options(**options).load(path)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, token) of a tokenizer file. ValueError unless it cuts lower-cased words into word pieces."""
    kind = "model struct<type: string, vocab: map<string, int>>, normalizer struct<type: string, lowercase: boolean>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j")).select("j.*")
    got = rows.select("model.type", F.col("normalizer.type").alias("normalizer"), "normalizer.lowercase").first()
    if got is None or tuple(got) != ("WordPiece", "BertNormalizer", True):
        raise ValueError(f"{path}: no tokenizer of lower-cased word pieces")
    return rows.select(F.explode("model.vocab").alias("piece", "token"))


def model(spark: SparkSession, folder: str) -> tuple[dict[str, int], DataFrame]:
    """(vocabulary, token vectors) of a folder with tokenizer.json and model.safetensors, for wordpiece.encoded and embedded.

    The vocabulary is collected, for it is broadcast: ValueError beyond MOST_VOCABULARY pieces, or if it has not one piece for each vector.
    """
    pieces, path = vocabulary(spark, f"{folder}/tokenizer.json"), f"{folder}/model.safetensors"
    rows, known = matrix(path).rows, pieces.count()
    if known != rows or known > MOST_VOCABULARY:
        raise ValueError(f"{folder}: {known} pieces for {rows} vectors")
    return {r.piece: r.token for r in pieces.toLocalIterator()}, token_vectors(spark, path)
