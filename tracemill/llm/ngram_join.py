"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.75 or more.

Prefix filtering with token combinations. Shingles are ordered from rare to frequent. Two similar
documents share the first shingle they have in common within the first n - ceil(0.75 n) + 1 of either.
Is that one rare, they meet under it alone. Is it frequent, they share frequent shingles only; then,
with the prefix m longer, m + 1 of them are in both prefixes, and with frequent shingles dealt by hash
to m classes, two are in one class: they meet under a pair. Frequent shingles alone index nothing.

How often a shingle occurs is counted over all shingles of all documents (copies met by one task count once). Tasks add up
what they hold, and counts travel as packed arrays by hash range. The table of frequent shingles that tasks get
is bounded: the least count that makes a shingle frequent is doubled until MOST_FREQUENT suffice. What
counts as frequent changes the work, never the result. Shingles are counted, and signatures matched, in PASSES passes
over the texts, each with its share of the hashes, so that no shuffle holds more than that share at once.

Documents with equal sets are one node from the start, and copies are never expanded: a task emits a node's signatures once
for all its copies. Under a signature that up to SMALL nodes share, all pairs are candidates; bitmaps of their sets rule out
most that are not similar, and the others are verified on the whole texts. Signatures that more nodes share connect these
to families. A family's nodes are dealt to blocks of bounded size, and each two blocks are one task's work, in which
all pairs are compared: it gives the number of links of each node and links that connect what is similar.

Cases: a null or empty text has an empty set and is linked with nothing; under five words the whole sequence is the
only shingle; repeated rows are one class; a null id takes part, and the component's id is the
smallest that is not null; an empty table gives an empty result; further columns are ignored
(`keep_first` keeps them, whatever their names).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Words, durable, keyed, mixed, numbered, slices
from tracemill.llm.components import components

MOST_FREQUENT = 2_000_000
LEAST_FREQUENT = 16
SMALL = 16
BLOCK_BYTES = 8 << 20
SPLIT_LEVEL = 8  # pairs of shingles counted 2 ** 9 times or more are split
LEAST_BITS, BITS_EACH = 1024, 4
HELD = 2_000_000
PASSES = 1
MOST_BROADCAST_NODES = 500_000


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, by text and hash, and the bounds of each text's part."""
    h, fits = w.windows(k)
    at = np.flatnonzero(fits)
    doc, h = w.doc[at], h[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = np.array([mixed(np.bitwise_xor.reduce(mixed(w.hash[w.first[i] : w.first[i + 1]] + np.arange(1, w.count[i] + 1, dtype=np.uint64))) + np.uint64(w.count[i])) for i in short], np.uint64).reshape(-1)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    bounds = np.searchsorted(doc, np.arange(len(w.count) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(w.count) + 1))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    text = batch.column(name).cast(pa.string())
    for a, b in slices(text):
        yield a, b, *shingles(Words(text.slice(a, b - a), lower=True))


def _names(h: np.ndarray, edges: np.ndarray, salt: int) -> np.ndarray:
    """64 bits that name each text's set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(salt)), dtype=np.uint64)])
    return mixed(total[edges[1:]] - total[edges[:-1]]).view(np.int64)


class Seen:
    """Names of sets that a task has met; it starts anew beyond `most`, which costs repeats only."""

    def __init__(self, most: int = 200_000):
        self.most, self.names = most, set()

    def new(self, names: np.ndarray) -> np.ndarray:
        if len(self.names) > self.most:
            self.names.clear()
        out = np.zeros(len(names), bool)
        for i, name in enumerate(names.tolist()):
            if name not in self.names:
                self.names.add(name)
                out[i] = True
        return out


def bitmaps(h: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bits that each set's shingles fall on: four or more a shingle, their number a power of two, LEAST_BITS at least."""
    n = np.diff(edges)
    size = LEAST_BITS << np.maximum(0, np.frexp(np.maximum(n, 1) * BITS_EACH / LEAST_BITS - 1e-9)[1])
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    out[np.repeat(ends - size, n) + (h % np.repeat(size, n).astype(np.uint64)).astype(np.int64)] = True
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(out, bitorder="little"))])


def may_be_similar(a: bytes, b: bytes, size: int) -> bool:
    """False where the bitmaps show that two sets (of so many shingles together) are not similar: each differing bit is a shingle that one lacks."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    return 100 * (size - differ) >= 75 * (size + differ)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_shingles, the set's name and its bitmap in place of __text."""
    for batch in batches:
        for a, b, h, edges in _texts(batch, "__text"):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("__k1", "__k2", "__id")), pa.array(np.diff(edges).astype(np.int64)), pa.array(_names(h, edges, 0)), bitmaps(h, edges)], ["__k1", "__k2", "__id", "n_shingles", "__node", "__bits"])


def _own(h: np.ndarray, turn: int) -> np.ndarray:
    """Which hashes belong to a pass."""
    return mixed(h) % np.uint64(PASSES) == np.uint64(turn)


def _counted(shift: int, low: int, turn: int, each: int = 1024):
    """Counts of a task's shingles of one pass, by range of their hashes: rows (part, keys, counts) of packed 32-bit numbers."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        part = (key >> np.uint64(low)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = np.unique(np.concatenate([[0], cuts, [len(key)], *(np.arange(a, b, each) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True))])).astype(int)
        rest, n = (key & np.uint64((1 << low) - 1)).astype("<u4"), n.astype("<u4")
        rows = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array([rest[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([n[a:b].tobytes() for a, b in rows], pa.binary())], ["__part", "__keys", "__counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = Seen(), [], 0
        for batch in batches:
            for _, _, h, edges in _texts(batch, "__text"):
                key = h[np.repeat(seen.new(_names(h, edges, 0)), np.diff(edges))] >> np.uint64(shift)
                held.append(key[_own(key, turn)])
                size += len(held[-1])
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _added(low: int, least: int):
    """Adds up the rows of each part, which come one after another, and gives the keys counted often."""

    def total(part: int, keys: list, counts: list) -> pa.RecordBatch:
        key, n = np.frombuffer(b"".join(keys), "<u4"), np.frombuffer(b"".join(counts), "<u4")
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order].astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        n = np.add.reduceat(n, first)
        often = n >= least
        found = (np.uint64(part) << np.uint64(low)) | key[first][often].astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.log2(n[often]).astype(np.int32))], ["__key", "__level"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []
        for batch in batches:
            for part, k, n in zip(*(batch.column(c).to_pylist() for c in ("__part", "__keys", "__counts")), strict=True):
                if part != now and keys:
                    yield total(now, keys, counts)
                    keys, counts = [], []
                now = part
                keys.append(k)
                counts.append(n)
        if keys:
            yield total(now, keys, counts)

    return run


def frequent_shingles(rows: DataFrame, shingles: int, most: int, least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(shift, keys, levels): the keys (hashes without their low bits) counted `least` times or more, at most `most` of them.

    Keys have six bits more than it takes to number all shingles, so few share one. A part holds four million of them or so,
    and what a key adds to it is one number for each two million shingles of a task.
    """
    bits = min(64, max(1, shingles).bit_length() + 6)
    low = min(28, bits)
    tables = []
    for turn in range(PASSES):
        counts = rows.mapInArrow(_counted(64 - bits, low, turn), "__part long, __keys binary, __counts binary")
        dealt = counts.repartition("__part").sortWithinPartitions("__part")
        tables.append(durable(dealt.mapInArrow(_added(low, least), "__key long, __level int"), "frequent"))
    found = functools.reduce(DataFrame.unionByName, tables)
    sizes = {r[0]: r[1] for r in found.groupBy("__level").count().collect()}
    level = min(sizes, default=0)
    while sum(n for x, n in sizes.items() if x >= level) > most:
        level += 1
    table = found.where(F.col("__level") >= level).toArrow()  # at most `most` rows of 12 bytes
    keys, levels = table["__key"].to_numpy().view(np.uint64), table["__level"].to_numpy()
    order = np.argsort(keys)
    return 64 - bits, keys[order], levels[order].astype(np.int8)


def signatures(h: np.ndarray, edges: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, level) of all sets of a slice, for single rare shingles (level 0) and for pairs (that of the rarer).

    h holds the sets' shingles between edges, level 0 marks rare ones.
    """
    n = np.diff(edges)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, level, of))
    h, level = h[order], level[order]
    rank = np.arange(len(h)) - edges[:-1][of]
    spare = n - (3 * n + 3) // 4
    rare = np.bincount(of[level == 0], minlength=len(n))
    single = rank < np.minimum(rare, spare + 1)[of]
    out = [(of[single], mixed(h[single]), np.zeros(int(single.sum()), np.int8))]
    size = np.frexp(n.astype(float))[1], np.frexp((4 * n // 3).astype(float))[1]  # bits of the number
    for own, also in ((size[0], rare <= spare), (size[1], (rare <= spare) & (size[0] != size[1]))):
        m = np.maximum(1, (1 << np.maximum(own - 1, 0)) // 8)
        at = np.flatnonzero(also[of] & (rank >= rare[of]) & (rank < (spare + 1 + m)[of]))
        word = own[of[at]].astype(np.uint64)
        deal = mixed(h[at] ^ word) % m[of[at]].astype(np.uint64)
        by = np.lexsort((deal, of[at]))
        at, deal, word = at[by], deal[by], word[by]
        for apart in range(1, len(at)):
            i = np.flatnonzero((of[at[:-apart]] == of[at[apart:]]) & (deal[:-apart] == deal[apart:]))
            if not len(i):
                break
            x, y = at[i], at[i + apart]
            sig = mixed(mixed(np.minimum(h[x], h[y])) * np.uint64(3) + mixed(np.maximum(h[x], h[y])) + word[i])
            out.append((of[x], sig, np.minimum(level[x], level[y])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signed(shared, shift: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = shared.value
        seen = Seen()
        for batch in batches:
            for _, _, h, edges in _texts(batch, "__text"):
                names, sizes = _names(h, edges, 0), np.diff(edges)
                new = seen.new(names) & (sizes > 0)
                h, names, sizes = h[np.repeat(new, np.diff(edges))], names[new], sizes[new]
                level = np.zeros(len(h), np.int8)
                if len(keys) and len(h):
                    key = h >> np.uint64(shift)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    level = np.where(keys[at] == key, levels[at], level)
                found = signatures(h, np.concatenate([[0], np.cumsum(sizes)]), level)
                of, sig, level = (x[_own(found[1], turn)] for x in found)
                parts = np.uint64(1) << np.maximum(level.astype(int) - SPLIT_LEVEL, 0).astype(np.uint64)
                salt = np.where(parts > 1, 1 + (mixed(names[of].view(np.uint64)) % parts).astype(np.int64), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(salt), pa.array(names[of]), pa.array(sizes[of].astype(np.int32))], ["__sig", "__salt", "__node", "__size"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for name in ("__ta", "__tb"):
            own = []
            for _, _, h, edges in _texts(batch, name):
                own.extend(h[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True))
            sets.append(own)
        same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], np.int64)
        both = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], np.int64) - same
        keep = pa.array(100 * same >= 75 * both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("__ba", "__bb", "__na", "__nb")]
        keep = [may_be_similar(x, y, n + m) for x, y, n, m in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts_of(some: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(__node, __text), a table: for each of some nodes the text of one row that has its set."""
    places = durable(nodes.join(some, "__node", "left_semi").select("__node", "__place.*"), "places")
    few = F.broadcast(places) if places.count() <= MOST_BROADCAST_NODES else places  # 20 bytes a node
    return durable(rows.select("__k1", "__k2", "__text").join(few, ["__k1", "__k2"]).select("__node", "__text").dropDuplicates(["__node"]), "texts")


def verify(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The linked ones of distinct candidate pairs (a, b) of nodes, as a table."""
    bits = [nodes.select(F.col("__node").alias(x), F.col("__bits").alias(f"__b{x}"), F.col("n_shingles").alias(f"__n{x}")) for x in "ab"]
    possible = durable(pairs.join(bits[0], "a").join(bits[1], "b").mapInArrow(_possible, "a long, b long"), "pairs")
    texts = _texts_of(possible.select(F.explode(F.array("a", "b")).alias("__node")).distinct(), rows, nodes)
    left = texts.select(F.col("__node").alias("a"), F.col("__text").alias("__ta"))
    right = texts.select(F.col("__node").alias("b"), F.col("__text").alias("__tb"))
    return durable(possible.join(left, "a").join(right, "b").select("a", "b", "__ta", "__tb").mapInArrow(_verified, "a long, b long"), "links")


def _alike(a: str, b: str):
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def links(rows: DataFrame, nodes: DataFrame, shingles: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes that connect all similar ones, and (__node, __links): how many nodes are similar to each that has any."""
    spark = rows.sparkSession
    shift, keys, levels = frequent_shingles(rows, shingles, MOST_FREQUENT, LEAST_FREQUENT)
    shared = spark.sparkContext.broadcast((keys, levels))
    # a node comes once from each task that holds a copy of it; the first of these rows counts
    own = Window.partitionBy("__sig", "__salt")
    new = (~F.lag("__node").over(own.orderBy("__node")).eqNullSafe(F.col("__node"))).cast("int")
    tables = []
    for turn in range(PASSES):
        posts = rows.mapInArrow(_signed(shared, shift, turn), "__sig long, __salt int, __node long, __size int")
        met = posts.withColumn("__new", new).withColumn("__c", F.sum("__new").over(own)).where("__new = 1 AND (__c > 1 OR __salt > 0)")
        tables.append(durable(met.select("__sig", "__salt", "__node", "__size", "__c"), "met"))
    met = functools.reduce(DataFrame.unionByName, tables)
    cold = (F.col("__c") <= SMALL) & (F.col("__salt") == 0)
    lists = met.where(cold).groupBy("__sig").agg(F.collect_list(F.struct("__node", "__size")).alias("__l"))
    few = lists.select(F.explode("__l").alias("x"), "__l").select("x", F.explode("__l").alias("y")).where((F.col("x.__node") < F.col("y.__node")) & _alike("x.__size", "y.__size"))
    linked = verify(few.select(F.col("x.__node").alias("a"), F.col("y.__node").alias("b")).distinct(), rows, nodes)
    return _hot(met.where(~cold).select("__sig", "__salt", "__node"), linked, rows, nodes)


def _degrees(linked: DataFrame) -> DataFrame:
    return linked.select(F.explode(F.array("a", "b")).alias("__node")).groupBy("__node").agg(F.count("*").alias("__links"))


def shared(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many members each two of the sets share."""
    out = np.zeros((len(left), len(right)), np.int64)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(both):
        return out
    places = []
    for side in (left, right):
        h, of = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.minimum(np.searchsorted(both, h), len(both) - 1)
        hit = both[at] == h
        places.append((of[hit], at[hit]))
    for c in range(0, len(both), width):
        has = [np.zeros((n, min(width, len(both) - c)), np.float32) for n in out.shape]
        for x, (of, at) in zip(has, places, strict=True):
            own = (at >= c) & (at < c + width)
            x[of[own], at[own] - c] = 1
        out += (has[0] @ has[1].T).astype(np.int64)
    return out


def compare(left: tuple, right: tuple, same: bool, most: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, links, spans) of two blocks (nodes, sets), or of one with itself if they are the same.

    links counts for each node the similar ones in the other block (the same one: itself not). spans are links, as rows of two
    nodes, that connect all that similar pairs connect.
    """
    nodes = left[0] if same else np.concatenate([left[0], right[0]])
    behind = 0 if same else len(left[0])
    counts, label, spans = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), []
    for i in range(0, len(left[0]), most):
        a = left[1][i : i + most]
        for j in range(i if same else 0, len(right[0]), most):
            b = right[1][j : j + most]
            total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None]
            n = shared(a, b)
            alike = 100 * n >= 75 * (total - n)
            x, y = np.arange(i, i + len(a)), np.arange(j, j + len(b)) + behind
            counts[x] += alike.sum(1)
            if not same or i != j:
                counts[y] += alike.sum(0)
            for r in np.flatnonzero((alike & (label[x][:, None] != label[y][None])).any(1)):
                for c in np.flatnonzero(alike[r]):
                    if label[y[c]] != label[x[r]]:
                        spans.append((nodes[x[r]], nodes[y[c]]))
                        label[label == label[y[c]]] = label[x[r]]
    return nodes, counts - same, np.array(spans, np.int64).reshape(-1, 2)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, null) for links and (node, null, n) for numbers of links."""
    for batch in batches:
        for row in range(len(batch)):
            nodes, counts, spans = compare(_members(batch.column("__left"), row), _members(batch.column("__right"), row), batch.column("__same")[row].as_py())
            nodes, counts = nodes[counts > 0], counts[counts > 0]
            none = [None] * len(spans)
            columns = np.concatenate([spans.min(1, initial=2**63 - 1), nodes]), [*spans.max(1, initial=-(2**63)).tolist(), *([None] * len(nodes))], [*none, *counts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "n"])


def _members(column: pa.Array, row: int) -> tuple:
    items = column[row].values
    return np.asarray(items.field("__node")), [np.frombuffer(x.as_py(), np.uint64) for x in items.field("__set")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, h, edges in _texts(batch, "__text"):
            sets = [h[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__node").slice(a, b - a), pa.array(sets, pa.binary())], ["__node", "__set"])


def _hot(posts: DataFrame, linked: DataFrame, rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the links under signatures that many nodes share.

    Nodes that such signatures connect are a family. All pairs of blocks of a family are compared once; links found
    elsewhere add to a node's number where they leave the family.
    """
    if not posts.head(1):
        return linked, _degrees(linked)
    # parts of a split signature meet in their smallest nodes, of which there are as many as parts
    least = posts.groupBy("__sig", "__salt").agg(F.min("__node").alias("__least"))
    first = least.groupBy("__sig").agg(F.min("__least").alias("b"))
    edges = posts.join(least, ["__sig", "__salt"]).select(F.col("__node").alias("a"), F.col("__least").alias("b"))
    family = components(edges.unionByName(least.join(first, "__sig").select(F.col("__least").alias("a"), "b")))
    own = posts.select("__node").distinct().join(family.select(F.col("a").alias("__node"), F.col("b").alias("__family")), "__node", "left")
    own = durable(own.withColumn("__family", F.coalesce("__family", "__node")), "families")
    sizes = own.join(nodes.select("__node", "n_shingles"), "__node").groupBy("__family").agg(F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES).alias("__blocks"))
    packed = _texts_of(own.select("__node"), rows, nodes).mapInArrow(_packed, "__node long, __set binary").join(own, "__node").join(sizes, "__family")
    block = F.pmod(F.xxhash64("__node"), F.col("__blocks"))
    every = durable(packed.groupBy("__family", "__blocks", block.alias("__block")).agg(F.collect_list(F.struct("__node", "__set")).alias("__left")), "blocks")
    low = every.select("__family", F.col("__block").alias("__low"), F.explode(F.sequence("__block", F.col("__blocks") - 1)).alias("__high"), "__left")
    high = every.select("__family", F.explode(F.sequence(F.lit(0).cast("bigint"), "__block")).alias("__low"), F.col("__block").alias("__high"), F.col("__left").alias("__right"))
    paired = low.join(high.hint("shuffle_merge"), ["__family", "__low", "__high"]).select("__left", "__right", (F.col("__low") == F.col("__high")).alias("__same"))
    found = durable(paired.mapInArrow(_compared, "a long, b long, n long"), "compared")
    of = own.select(F.col("__node").alias("a"), F.col("__family").alias("__fa")), own.select(F.col("__node").alias("b"), F.col("__family").alias("__fb"))
    leaving = linked.join(of[0], "a", "left").join(of[1], "b", "left").where("__fa IS NULL OR __fb IS NULL OR __fa <> __fb")
    inside = found.where("n IS NOT NULL").select(F.col("a").alias("__node"), F.col("n").alias("__links"))
    degrees = inside.unionByName(_degrees(leaving)).groupBy("__node").agg(F.sum("__links").alias("__links"))
    return linked.unionByName(found.where("b IS NOT NULL").select("a", "b")), degrees


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (smallest id reachable by links), class_links (how many other sets are similar to its set; only if counted).

    Sets are named by 64 bits; texts are read for each pass, shuffled only where they are candidates.
    """
    rows = keyed(docs, id_col, text_col)
    kind = dict(rows.dtypes)["__id"]
    sets = durable(rows.mapInArrow(_sets, f"__k1 long, __k2 int, __id {kind}, n_shingles long, __node long, __bits binary"), "sets")
    alone = F.col("n_shingles") == 0
    each = F.min("__id").alias("__least"), F.min(F.struct("__k1", "__k2")).alias("__place"), F.min("n_shingles").alias("n_shingles"), F.min("__bits").alias("__bits")
    nodes = durable(sets.where(~alone).groupBy("__node").agg(*each), "nodes")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    found, degree = links(rows, nodes, total)
    root = components(found).select(F.col("a").alias("__node"), F.col("b").alias("__root"))
    known = nodes.select("__node", "__least").join(root, "__node", "left").withColumn("__root", F.coalesce("__root", "__node"))
    if counted:
        known = known.join(degree, "__node", "left").withColumn("class_links", F.coalesce("__links", F.lit(0)))
    known = durable(known, "components")
    least = known.groupBy("__root").agg(F.min("__least").alias("component_id"))
    more = ["class_links"] if counted else []
    out = sets.join(known.join(least, "__root").select("__node", "component_id", *more), "__node", "left")
    component = F.when(alone, F.col("__id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select(F.col("__id").alias(id_col), "n_shingles", component, *(F.when(alone, 0).otherwise(F.col(c)).alias(c) for c in more))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near copies, that with the smallest id; documents without any word all stay.

    Of rows alike in that id and text, one stays, whole. Only ids are shuffled for the choice; texts move once, by row key.
    """
    rows, at = numbered(docs)
    own_id, own_text = F.col(at[id_col]), F.col(at[text_col])
    key = F.struct(F.xxhash64(own_id, F.lit("|"), own_text).alias("a"), F.xxhash64(F.lit("|"), own_text, own_id).alias("b"))
    named = rows.select(F.struct(own_id.isNull().alias("n"), own_id.alias("i"), key.alias("k")).alias("__key"), own_text.alias("__body"))
    joined = durable(ngram_join(named, "__key", "__body", counted=False), "near")
    chosen = joined.where((F.col("n_shingles") == 0) | (F.col("__key") == F.col("component_id"))).select(F.col("__key.k").alias("__row")).distinct()
    kept = rows.withColumn("__row", key).join(chosen, "__row", "left_semi")
    empty = F.coalesce(F.length(F.regexp_replace(own_text, r"[\x20\x09-\x0D]", "")), F.lit(0)) == 0
    first = kept.where(~empty).groupBy("__row").agg(F.first(F.struct(*rows.columns)).alias("r")).select("r.*")
    return first.unionByName(kept.where(empty).select(*rows.columns)).toDF(*docs.columns)
