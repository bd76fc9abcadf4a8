"""Quality rules: exact counts, two fixed rules, and gradient-boosted trees over document statistics.

The counts are exact and vectorised over the bytes of a slice of texts. The trees are fitted in
numpy on the driver from at most `sample` labelled documents of each class (documented bound), none
of them of held-out fold 1, and then score every document in Arrow batches. Scores can only fall as symbols, repeated
lines, repeated words, capitals or exclamation marks get more (monotonic constraints).

Cases: a null or empty text has no words and fails the rules; documents without any label table
rows are judged by the rules alone; labels may be null, repeated or missing; repeated rows get
equal results; an empty table gives an empty result; further columns pass through `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Words, labelled_sample, numbered, slices, small_batches
from tracemill.llm.trees import Trees, fit

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Feature and the direction in which it may move the score.
FEATURES = (("log_words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeat_words", -1), ("capitals", -1), ("digits", 0), ("marks", -1), ("distinct_words", 0), ("line_words", 0))


def _per(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS as columns of integers, and FEATURES, for each text."""
    w = Words(column)
    n, data = len(column), w.data
    begins = (data & 0xC0) != 0x80  # first bytes of characters
    words = w.count.astype(np.int64)
    spaces = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    chars = _per(begins & ~spaces, w.offsets)
    symbols = _per(SYMBOLS[data], w.offsets)

    # windows of five words, twice or more in one text
    repeat = np.zeros(n, np.int64)
    distinct = np.zeros(n)
    if len(w.starts):
        h, fits = w.windows(5)
        at = np.flatnonzero(fits)
        if len(at):
            own = h[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(own)
            same = own[order][1:] == own[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(w.starts) + 1, np.int32)
            np.add.at(edge, at[twice], 1)
            np.add.at(edge, at[twice] + 5, -1)
            repeat = np.bincount(w.doc[np.cumsum(edge[:-1]) > 0], minlength=n).astype(np.int64)
        own = np.unique(w.hash + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
        distinct = np.bincount(w.doc[own], minlength=n)

    raw, dup, lines = data.tobytes(), np.zeros(n, np.int64), np.zeros(n)
    for i in range(n):
        have = [x for x in raw[w.offsets[i] : w.offsets[i + 1]].split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
        lines[i] = len(have)
        dup[i] = len(have) - len(set(have))
    counts = np.stack([words, chars, symbols, dup, repeat], 1)
    size, some = np.maximum(chars, 1), np.maximum(words, 1)
    features = np.stack(
        [
            np.log1p(words),
            chars / some,
            symbols / size,
            dup / np.maximum(lines, 1),
            repeat / some,
            _per(UPPER[data], w.offsets) / size,
            _per(DIGIT[data], w.offsets) / size,
            _per(data == 33, w.offsets) / some,
            distinct / some,
            words / np.maximum(lines, 1),
        ],
        1,
    ).astype(float)
    return counts, features


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("__text").cast(pa.string())
        for a, b in slices(text):
            features = statistics(text.slice(a, b - a))[1]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("__name").slice(a, b - a), batch.column("__label").slice(a, b - a), lists], ["__name", "__label", "features"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from a bounded sample of labelled documents. Tasks take the statistics; texts don't reach the driver, only ten numbers each."""
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", sample, id_col, text_col)
    rows = rows.select(F.col("__id").cast("string").alias("__name"), "__label", "__text").mapInArrow(_features, "__name string, __label int, features array<double>")
    rows = sorted({(r["__name"], r["__label"], tuple(r["features"])) for r in rows.collect()})
    return fit(np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float), tuple(s for _, s in FEATURES))


def _judge(model: Trees, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("__text").cast(pa.string())
            for a, b in slices(text):
                counts, features = statistics(text.slice(a, b - a))
                failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
                score = model.score(features)
                kept = ~failed & (score >= cut)
                columns = [batch.column(c).slice(a, b - a) for c in batch.schema.names if c != "__text"]
                names = [c for c in batch.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(score), pa.array(kept)], [*names, *COUNTS, "base_failed", "score", "kept"])

    return run


def judge(docs: DataFrame, model: Trees, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the counts, base_failed, score (of good quality), kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = dict(rows.dtypes)["__id"]
    out = rows.mapInArrow(_judge(model, cut), f"__id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")
    return out.withColumnRenamed("__id", id_col)


def _keep(model: Trees, cut: float, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(column).cast(pa.string())
            kept = []
            for a, b in slices(text):
                counts, features = statistics(text.slice(a, b - a))
                failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
                kept.append(~failed & (model.score(features) >= cut))
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return run


def keep_good(docs: DataFrame, model: Trees, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns; no shuffle."""
    small_batches(docs.sparkSession)
    rows, at = numbered(docs)
    return rows.mapInArrow(_keep(model, cut, at[text_col]), rows.schema).toDF(*docs.columns)
