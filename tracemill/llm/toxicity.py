"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

The network reads words as an embedding and the mean of their character trigrams' embeddings. It runs
through a text in both directions; the attention pools the states of a window of LENGTH words. Every document is scored over
all its windows, one from each word on; the largest score counts. The states are computed once and shared by all windows that
hold the word, so a window knows the words around it, and all windows cost hardly more than one. It is trained on windows with CONTEXT words on
either side, beyond which a state remembers nothing that counts: a window scored by itself, with that context, has the score it has in its text.

It is trained in numpy on the driver from at most `sample` labelled documents of each class (a documented bound), none of
held-out fold 1. In each epoch a document teaches with the windows that the network itself finds most toxic, since those
decide its score; a clean one with some others too. An epoch looks at one window each APART words, from another word on
than the last epoch. Before the network knows anything, windows are ranked by how much more often toxic training documents hold their words; that
number is no input. Input projections are computed once for each distinct
word, and slices of texts go through one at a time, so memory is bounded by the slice.

Cases: null and empty texts score 0; without labelled rows of both classes every score is 0; repeated rows get
equal scores; labels, languages, sources and ids are no inputs; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import fold, labelled_sample, slices, small_batches
from tracemill.llm.gru import HIDDEN, Adam, Network, summed

LENGTH = 32
APART, CONTEXT = 24, 48
DOUBT = 0.2
STEPS = 400
MOST_EPOCHS = 20  # times as many as asked for, where a small sample has few steps in one
WORDS, TRIGRAMS = 4096, 4096
MOST_WORDS = 300_000


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]|*#$%&")


def _numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number of each word, trigram numbers of all in a row, and how many each has."""
    raw = [f"^{w}$ ".encode() for w in words]  # the space keeps one trigram in the shortest
    ids = np.fromiter((zlib.crc32(w) % WORDS for w in raw), np.int64, len(raw))
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    codes = (data[:-2] * 961 + data[1:-1] * 31 + data[2:]) % TRIGRAMS if len(data) else data
    ends = np.cumsum(sizes)
    inside = np.ones(len(codes), bool)
    for back in (1, 2):  # trigrams that reach into the next word
        cut = ends - back
        inside[cut[cut < len(codes)]] = False
    return ids, codes[inside], sizes - 2


def _some(numbers: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of some of the words."""
    ids, codes, count = numbers
    starts, n = (np.cumsum(count) - count)[rows], count[rows]
    return ids[rows], codes[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def spread(counts: np.ndarray, stride: int = 1, back: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts with so many words, which stand in a row: text and first word of each.

    One each `stride` words, all but a text's first and last moved back by `back`.
    """
    more = np.where(counts > LENGTH, -(-(counts - LENGTH + back) // stride), 0)
    each = np.where(counts > 0, 1 + more, 0)
    text = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    start = np.clip(nth * stride - back, 0, np.maximum(counts[text] - LENGTH, 0))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return text, first[text] + start


def _windows(text: np.ndarray, start: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of gates of windows with the words around them, which steps hold a word, and which the window itself."""
    ends = np.cumsum(counts)[text]
    steps = start[:, None] + np.arange(-CONTEXT, LENGTH + CONTEXT)[None]
    real = (steps >= (ends - counts[text])[:, None]) & (steps < ends[:, None])
    pool = real & (steps >= start[:, None]) & (steps < start[:, None] + LENGTH)
    return at[np.clip(steps, 0, len(at) - 1)], real, pool


class Scorer:
    """A trained network; keeps the gates of at most MOST_WORDS words."""

    def __init__(self, network: Network | None):
        self.network = network
        self.clear()

    def __getstate__(self):
        return {"network": self.network}

    def __setstate__(self, state):
        self.__init__(**state)

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.forms: dict[str, int] = {}
        self.gates = {way: np.zeros((0, 3 * HIDDEN), np.float32) for way in "fb"}

    def _learn(self, words: list[str], have: int) -> None:
        """Gates of words that are new; the table doubles when it is full."""
        if have + len(words) > len(self.gates["f"]):
            self.gates = {way: np.concatenate([x, np.zeros((max(len(words), len(x)), 3 * HIDDEN), np.float32)]) for way, x in self.gates.items()}
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            for way, x in self.network.projected(self.network.inputs(*_numbers(part))).items():
                self.gates[way][have + i : have + i + len(part)] = x

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The largest window score of each text."""
        out = np.zeros(len(texts))
        split = [t.split() for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        if self.network is None or not counts.sum():
            return out
        if len(self.known) > MOST_WORDS:
            self.clear()
        # words that differ in case and punctuation only are one word here
        known, forms, new = self.known, self.forms, []
        for s in split:
            for w in s:
                if w not in known:
                    form = plain(w)
                    if form not in forms:
                        forms[form] = len(forms)
                        new.append(form)
                    known[w] = forms[form]
        if new:
            self._learn(new, len(forms) - len(new))
        at = np.fromiter((known[w] for s in split for w in s), np.int64, counts.sum())
        top = tops(self.network.every(self.gates, at, counts, LENGTH), counts)
        return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(top, -30, 30))), 0)


def tops(logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest of each text's windows: all that are whole, or, in a text too short for one, the text."""
    out = np.full(len(counts), -np.inf)
    some = np.flatnonzero(counts > 0)
    nth = np.arange(len(logits)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = nth <= np.repeat(np.maximum(counts - LENGTH, 0), counts)
    if len(some):
        out[some] = np.maximum.reduceat(np.where(whole, logits, -np.inf), (np.cumsum(counts) - counts)[some])
    return out


def _log_odds(t, n, toxic: int, clean: int):
    """How much more often toxic documents hold a word, in -1 to 1; words in few of the documents count little."""
    return np.tanh((np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))) / 3) * (t + n) / (t + n + 2 + 0.05 * toxic)


def _among_others(split: list[list[str]], y: np.ndarray, rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Adds each short text once more with words of clean ones around it, as a passage stands in a text; labels stay."""
    clean = np.flatnonzero((y == 0) & np.array([len(s) > 0 for s in split]))
    short = [n for n, s in enumerate(split) if 0 < len(s) < LENGTH + CONTEXT]
    if not len(clean):
        return split, y

    def some() -> list[str]:
        words = split[rng.choice(clean)]
        return (words * (1 + CONTEXT // len(words)))[:CONTEXT]

    return [*split, *(some() + split[n] + some() for n in short)], np.concatenate([y, y[short]]) if short else y


def train(docs: DataFrame, labels: DataFrame, sample: int = 1000, epochs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A scorer from a bounded sample of labelled documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, "toxic", sample, id_col, text_col).collect()
    rows = sorted({(str(r["__id"]), r["__label"], r["__text"]) for r in rows})
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], int), epochs)


def fit(texts: list[str], y: np.ndarray, epochs: int = 10) -> Scorer:
    """Trains on the labelled texts. Texts that occur more than once count once."""
    texts, first = np.unique(np.array(texts, object), return_index=True) if len(texts) else ([], [])
    y = y[first] if len(first) else y
    split = [[plain(w) for w in t.encode().split()] for t in texts]
    toxic, clean = int((y == 1).sum()), int((y == 0).sum())
    if not toxic or not clean:
        return Scorer(None)
    seen = {1: Counter(), 0: Counter()}
    for s, label in zip(split, y, strict=True):
        seen[int(label)].update(set(s))
    rng = np.random.default_rng(3)
    split, y = _among_others(split, y, rng)
    scorer = Scorer(Network(WORDS, TRIGRAMS))
    names: dict[str, int] = {}
    counts = np.array([len(s) for s in split], np.int64)
    at = np.fromiter((names.setdefault(w, len(names)) for s in split for w in s), np.int64, counts.sum())
    keys = list(names)
    t, n = (np.array([seen[k][w] for w in keys], float) for k in (1, 0))
    odds = np.where(t + n >= 3, _log_odds(t, n, toxic, clean), 0).astype(np.float32)
    numbers = _numbers(keys)
    net = scorer.network
    adam = Adam(net.p, 0.01)
    text, start = spread(counts, APART)
    at_all, real_all, pool_all = _windows(text, start, counts, at)
    label = y[text].astype(np.float32)
    top = np.where(pool_all, odds[at_all], -1).max(1)
    done = 0
    for epoch in range(MOST_EPOCHS * epochs):
        if epoch >= epochs and done >= STEPS:
            break
        adam.rate = 0.01 / (1 + max(done / STEPS - 0.3, 0) * 8)  # smaller steps to the end
        order = np.lexsort((-top, text))
        rank = np.empty(len(text), int)
        rank[order] = np.arange(len(text)) - np.searchsorted(text[order], text[order])
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, text, top)
        # after the first third, a toxic label that no window of the text bears out teaches no more: some labels are wrong
        believed = (done < STEPS / 3) | (best[text] > DOUBT)
        teaches = np.where(label == 1, believed & ((rank == 0) | (top > 0.5) & (top >= best[text] - 0.3) & (rank < 3)), (rank < 2) | (rng.random(len(text)) < 0.08))
        use = np.flatnonzero(teaches)
        rng.shuffle(use)
        balance = (label[use] == 0).sum() / max(1, (label[use] == 1).sum())
        for i in range(0, len(use), 256):
            own = use[i : i + 256]
            rows, back = np.unique(at_all[own], return_inverse=True)
            ids, codes, count = _some(numbers, rows)
            drop = rng.random(len(rows)) < 0.5
            x = net.inputs(np.where(drop, 0, ids), codes, count)
            weight = np.where(label[own] == 1, min(balance, 4.0), 1.0).astype(np.float32)
            slopes, dx = net.slopes(x, back.reshape(at_all[own].shape), real_all[own], label[own], weight, pool_all[own])
            wide = net.p["words"].shape[1]
            dw = summed(np.where(drop, 0, ids), dx[:, :wide], WORDS)
            dc = summed(codes, np.repeat(dx[:, wide:] / count[:, None], count, axis=0), TRIGRAMS)
            done += 1
            adam.move(slopes | {"words": dw, "chars": dc}, 1e-4)
        parts = [net.projected(net.inputs(*_some(numbers, np.arange(i, min(i + 20_000, len(keys)))))) for i in range(0, len(keys), 20_000)]
        gates = {way: np.concatenate([p[way] for p in parts]) for way in "fb"}
        text, start = spread(counts, APART, int(rng.integers(APART)))
        at_all, real_all, pool_all = _windows(text, start, counts, at)
        label = y[text].astype(np.float32)
        top = 1 / (1 + np.exp(-np.clip(net.every(gates, at, counts, LENGTH)[start], -30, 30)))
    return scorer


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            text = batch.column("__text").cast(pa.string()).fill_null("")
            for a, b in slices(text, 2 << 20):
                found = scorer.scores(text.slice(a, b - a).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(a, b - a), pa.array(found)], ["__id", "score"])

    return run


def score(docs: DataFrame, scorer: Scorer, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. No shuffle; the network (under 2 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = dict(rows.dtypes)["__id"]
    out = rows.mapInArrow(_score(shared), f"__id {kind}, score double")
    return out.select(F.col("__id").alias(id_col), F.coalesce(fold("__id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
