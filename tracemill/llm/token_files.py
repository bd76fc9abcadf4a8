"""Token ids as ORC files.

Documents are put in ascending id order by range (a third of all rows may share a source, but
ids spread), encoded in Arrow batches, and written by Spark's ORC writer: integer run-length
encoding of the ids, a row index every `index_stride` rows, Bloom filters on the document id.
Stripes are read in parallel, and a filter on the id skips files, stripes and row groups by
their statistics and Bloom filters. Each row has its place in its file (`pos`) and the ids before
it in its file (`before`), so a document's start among all ids needs one sum a file, read from two
narrow columns.

White space ends every pre-token of the default tokenizer, and so does a mark behind a letter, so a
text's ids are those of its words in a row, and a word's those of what stands before its last marks and of
these. Each distinct one is encoded once in a task while a bounded table has it.
Texts go through it whole, with none cut.

Cases: a null or empty text has the end id alone; null ids come first; rows of one id stand
together in any order; an empty table gives empty files and results; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import scratch_dir, slices, small_batches

MOST_WORDS = 400_000
TEXT_BYTES = 4 << 20
MOST_FILES = 500_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary is; asked for on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(shown)))}


_ALPHABET = _byte_alphabet()
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _plain(word: str) -> bool:
    """Whether normalising and pre-tokenizing leave a word as it is: lower-case letters only."""
    return word.isalpha() and word.islower() if word.isascii() else word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


def _listed(words: pa.Array) -> list[bytes]:
    """The words, none of which has a space, as Python's bytes; faster than to_pylist."""
    if not len(words):
        return []
    row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()))
    return pc.binary_join(row, b" ")[0].as_py().split(b" ")


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat with these starts and lengths in a row, and where each ends."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Ids of whole texts; keeps those of some MOST_WORDS distinct pieces, and the more frequent half when that is full.

    A word with marks at its end is two pieces, cut between a letter or digit and the first mark: no
    pre-token goes across. Arrow splits a slice of texts and numbers its distinct words, so Python sees each
    of them once. Pieces of lower-case letters only go to the tokenizer's merge model directly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.seen, self.cut = np.zeros(0, np.int64), np.zeros(0, bool)  # how often of late; whether marks behind it are a piece

    def _forget(self) -> None:
        keep = np.sort(np.argpartition(-self.seen, MOST_WORDS // 2)[: MOST_WORDS // 2])
        kept = np.zeros(len(self.seen), bool)
        kept[keep] = True
        self.known = {w: n for n, w in enumerate(itertools.compress(self.known, kept.tolist()))}
        self.flat, ends = _gathered(self.flat, self.starts[keep], self.lengths[keep])
        self.lengths, self.cut, self.seen = self.lengths[keep], self.cut[keep], np.zeros(len(keep), np.int64)
        self.starts = ends - self.lengths

    def _learn(self, pieces: list[bytes]) -> None:
        found: list[list[int]] = [[]] * len(pieces)
        cut = np.ones(len(pieces), bool)
        rest, model, normalizer = [], self.tokenizer.model, self.tokenizer.normalizer
        for n, piece in enumerate(pieces):
            text = piece.decode()
            if _plain(text):
                found[n] = [t.id for t in model.tokenize(text if text.isascii() else piece.decode("latin-1").translate(_ALPHABET))]
            elif text:
                rest.append(n)
                last = (text if text.isascii() else normalizer.normalize_str(text))[-1:]
                cut[n] = last.isalpha() or last.isascii() and last.isdigit()
        for n, x in zip(rest, self.tokenizer.encode_batch_fast([pieces[n].decode() for n in rest], add_special_tokens=False), strict=True):
            found[n] = x.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum()))])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.seen, self.cut = np.concatenate([self.seen, np.zeros(len(found), np.int64)]), np.concatenate([self.cut, cut])

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            self._learn(list(dict.fromkeys(pieces[n] for n in new.tolist())))
            numbers[new] = [self.known[pieces[n]] for n in new.tolist()]
        return numbers

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's with end_id behind, and how many each text has."""
        if len(self.known) > MOST_WORDS:
            self._forget()
        named = pc.match_substring(texts, "<|")  # names of special tokens have a case
        some = named.true_count > 0
        lowered = pc.if_else(named, texts, pc.ascii_lower(texts)) if some else pc.ascii_lower(texts)
        rows = pc.ascii_split_whitespace(lowered)
        coded = rows.flatten().dictionary_encode()
        words, at = _listed(coded.dictionary), coded.indices.to_numpy()
        # each distinct word's pieces
        cores = [w.rstrip(_MARKS) for w in words]
        whole = [n for n, w in enumerate(words) if b"<|" in w] if some else []
        for n in whole:
            cores[n] = words[n]
        first = self._numbers(cores)
        marked = np.fromiter(map(len, words), np.int64, len(words)) > np.fromiter(map(len, cores), np.int64, len(words))
        whole = np.flatnonzero(marked & ~self.cut[first])
        for n in whole.tolist():
            cores[n] = words[n]
        first[whole] = self._numbers([words[n] for n in whole.tolist()])
        pieces = np.stack([first, self._numbers([w[len(c) :] for w, c in zip(words, cores, strict=True)])], 1)
        np.add.at(self.seen, pieces, np.bincount(at, minlength=len(words))[:, None])
        flat, _ = _gathered(self.flat, self.starts[pieces].ravel(), self.lengths[pieces].ravel())
        # the texts from their words' numbers, with one more number for the end
        flat, lengths = np.append(flat, np.int32(end_id)), np.append(self.lengths[pieces].sum(1), 1)
        last = rows.offsets.to_numpy()[1:].astype(np.int64) + np.arange(len(texts))
        numbers = np.full(len(at) + len(texts), len(words))
        inside = np.ones(len(numbers), bool)
        inside[last] = False
        numbers[inside] = at
        ids, ends = _gathered(flat, (np.cumsum(lengths) - lengths)[numbers], lengths[numbers])
        return ids, np.diff(ends[last], prepend=0)


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One encoder for the tasks that a Python worker runs in turn."""
    return Encoder(path)


def _encode(name: str, end_id: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or tokenizer_path(name))
        pos, before = 0, 0
        for batch in batches:
            column = batch.column("__text").cast(pa.string()).fill_null("")
            for a, b in slices(column, TEXT_BYTES):
                ids, counts = encoder.encode(column.slice(a, b - a), end_id)
                edges = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").slice(a, b - a), pa.array(pos + np.arange(b - a, dtype=np.int64)), pa.array(before + edges[:-1].astype(np.int64)), pa.array(counts.astype(np.int64)), lists],
                    ["doc_id", "pos", "before", "n_tokens", "ids"],
                )
                pos, before = pos + b - a, before + int(edges[-1])

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, tokenizer_file: str | None = None, end_id: int = 1, stripe_bytes: int = 16 << 20, index_stride: int = 1000) -> None:
    """Write (doc_id, pos, before, n_tokens, ids) under path, in ascending id order over files and rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = dict(rows.dtypes)["__id"]
    (
        rows.repartitionByRange(F.col("__id").asc_nulls_first())
        .sortWithinPartitions(F.col("__id").asc_nulls_first())
        .mapInArrow(_encode(tokenizer, end_id, tokenizer_file), f"doc_id {kind}, pos long, before long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", index_stride)
        .option("orc.stripe.size", stripe_bytes)
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, file, pos): what write_tokens wrote, with each document's start among all ids."""
    stored = spark.read.orc(path)
    rows = stored.withColumn("file", F.col("_metadata.file_name"))
    # `before` runs on where Spark cuts a part into several files, so a file holds what is behind its first row
    files = rows.groupBy("file").agg((F.max(F.col("before") + F.col("n_tokens")) - F.min("before")).alias("__sum"), F.min("before").alias("__from"))
    # part-00010-...c003: parts by number (more than five digits sort wrongly as text), then the files of one part
    part, piece = (F.coalesce(F.nullif(F.regexp_extract("file", p, 1), F.lit("")).cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"c(\d+)\."))
    earlier = Window.orderBy(part, piece, "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", (F.coalesce(F.sum("__sum").over(earlier), F.lit(0)) - F.col("__from")).alias("__base"))
    if len(stored.inputFiles()) <= MOST_FILES:  # a row a file: some 50 MB at most
        bases = F.broadcast(bases)
    return rows.join(bases, "file").select("doc_id", (F.col("__base") + F.col("before")).alias("start"), "n_tokens", "ids", "file", "pos")


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of a few documents; the filter reaches the reader, which skips by statistics and Bloom filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(list(ids)))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = np.asarray(lists.offsets)
        values = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document in the files: id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    rows = read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids")
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(_crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("doc_id", id_col)


def tokenize_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write docs' ids to a new folder of the shared directory and give the digest of what is read back."""
    path = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, id_col, text_col, **options)
    return token_digest(docs.sparkSession, path, id_col)
