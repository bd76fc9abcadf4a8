"""Benchmark decontamination by pigeonhole edit matching.

A document leaks an item where some stretch of it is within the item's error budget: one edit for
each `chars_per_edit` characters, whatever its length. A budget of k edits cannot touch all of k + 1 pieces, so one piece
is there as it is. An Aho-Corasick automaton over all pieces finds those in one pass over a text;
around each hit, Myers' bit-parallel distance over the item's whole length decides.

Texts are compared in lower case with one space for each run of white space. Items travel in
blocks of at most `block_chars` characters; a larger benchmark takes more passes over the
documents, never a larger broadcast. There is no shuffle with one block, and with several only
the hits are shuffled.

Cases: null or empty documents leak nothing; null and empty items are not looked for; where `word_chars` is given (it is 0), items of fewer characters
count only as they are and as whole words, since so short a stretch turns up within words by chance; equal items are all reported; item ids may
be of any type; repeated rows get equal results; an empty table on either side gives no leaks; further columns are ignored (`keep_clean`
keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracemill.llm.common import durable, keyed, numbered


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, chars_per_edit: int) -> int:
    return len(item) // chars_per_edit


def pieces(item: str, count: int) -> list[tuple[int, str]]:
    """The item in `count` parts of nearly equal length, each with its offset."""
    edges = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def distance_within(eq: dict[str, int], m: int, text: str) -> int:
    """The least edit distance between a pattern of length m > 0 and any stretch of text (Myers, bit-parallel)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for ch in text:
        e = eq.get(ch, 0)
        v = e | down
        h = (((e & up) + up) ^ up) | e
        right, left = down | (full & ~(h | up)), up & h
        if right & top:
            score += 1
        elif left & top:
            score -= 1
            if score < best:
                best = score
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (full & ~(v | right)), right & v
    return best


class Matcher:
    """Finds a block of items in normalized texts."""

    def __init__(self, items: list[tuple], chars_per_edit: int, word_chars: int = 0):
        self.items = [(key, text, 0 if len(text) < word_chars else budget(text, chars_per_edit)) for key, text in items]
        self.word_chars = word_chars
        self.masks: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k + 1):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item id, distance) of the items that the text leaks, by id."""
        if not self.items or not text:
            return []
        spots: dict[int, list[int]] = {}
        for end, (length, at) in self.automaton.iter(text):
            for n, offset in at:
                spots.setdefault(n, []).append(end + 1 - length - offset)
        found = []
        for n, starts in spots.items():
            key, item, k = self.items[n]
            m, best, reach = len(item), k + 1, -1
            if m < self.word_chars:
                if any(not text[max(0, s - 1) : s].isalnum() and not text[s + m : s + m + 1].isalnum() for s in starts):
                    found.append((key, 0))
                continue
            spans: list[list[int]] = []
            for s in sorted(set(starts)):
                a, b = max(0, s - k), min(len(text), s + m + k)
                if a <= reach:
                    spans[-1][1] = reach = max(reach, b)
                else:
                    spans.append([a, b])
                    reach = b
            for a, b in spans:
                window = text[a:b]
                if item in window:
                    best = 0
                    break
                if n not in self.masks:
                    self.masks[n] = masks(item)
                best = min(best, distance_within(self.masks[n], m, window))
            if best <= k:
                found.append((key, best))
        return sorted(found)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks; rows come to the driver one partition at a time."""
    block, size = [], 0
    for key, text in items.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        text = normalized(text)
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield block


_MATCHERS: dict[int, Matcher] = {}


def _matcher(shared, *options: int) -> Matcher:
    """One matcher is kept for the tasks that a Python worker runs in turn."""
    if shared.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[shared.id] = Matcher(shared.value, *options)
    return _MATCHERS[shared.id]


class _Shared:
    """A broadcast block with an id of its own."""

    def __init__(self, spark, block):
        self.broadcast = spark.sparkContext.broadcast(block)
        self.id = hash((id(spark), self.broadcast._jbroadcast.id()))

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _find(shared: _Shared, kind: pa.DataType, *options: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, *options)
        for batch in batches:
            found = [matcher.find(normalized(x.as_py() or "")) for x in batch.column("__text")]
            columns = [batch.column(c) for c in ("__k1", "__k2", "__id")]
            columns += [pa.array([[k for k, _ in x] for x in found], pa.list_(kind)), pa.array([[d for _, d in x] for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["__k1", "__k2", "__id", "item_ids", "distances"])

    return run


def leaks(docs: DataFrame, items: DataFrame, chars_per_edit: int = 16, word_chars: int = 0, block_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: id, leaked, n_items, item_ids (ascending) and their distances."""
    rows = keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["__id"]
    item_kind = dict(items.dtypes)[item_col]
    arrow = to_arrow_type(items.schema[item_col].dataType)
    schema = f"__k1 long, __k2 int, __id {kind}, item_ids array<{item_kind}>, distances array<int>"
    blocks = [rows.mapInArrow(_find(_Shared(docs.sparkSession, b), arrow, chars_per_edit, word_chars), schema) for b in item_blocks(items, item_col, item_text_col, block_chars)]
    if len(blocks) == 1:
        out = blocks[0]
    else:
        empty = F.array().cast(f"array<{item_kind}>").alias("item_ids"), F.array().cast("array<int>").alias("distances")
        out = rows.select("__k1", "__k2", "__id", *empty)
        if blocks:
            hits = blocks[0]
            for more in blocks[1:]:
                hits = hits.unionByName(more)
            pair = F.arrays_zip("item_ids", "distances")
            hits = hits.where(F.size("item_ids") > 0).groupBy("__k1", "__k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pair)))).alias("__found"))
            hits = durable(hits, "leaks")
            out = rows.select("__k1", "__k2", "__id").join(hits, ["__k1", "__k2"], "left").select("__id", F.coalesce("__found.item_ids", empty[0]).alias("item_ids"), F.coalesce("__found.distances", empty[1]).alias("distances"))
    return out.select(F.col("__id").alias(id_col), (F.size("item_ids") > 0).alias("leaked"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "distances")


def _clean(shared: _Shared, column: str, *options: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, *options)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(normalized(x.as_py() or "")) for x in batch.column(column)], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, items: DataFrame, chars_per_edit: int = 16, word_chars: int = 0, block_chars: int = 2_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with all their columns; no shuffle."""
    out, at = numbered(docs)
    schema = out.schema
    for block in item_blocks(items, item_col, item_text_col, block_chars):
        out = out.mapInArrow(_clean(_Shared(docs.sparkSession, block), at[text_col], chars_per_edit, word_chars), schema)
    return out.toDF(*docs.columns)
