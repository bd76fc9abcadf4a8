"""Personal data: exact patterns, and a linear-chain conditional random field that adds spans.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by the stated patterns,
leftmost and non-overlapping for each kind; a match that fails its check is dropped. It is written so that no text
takes more than linear time. The field, over word shapes and cue words and trained from a small
labelled table, tags all words of a text, and so adds what the patterns don't have: phone numbers without a plus,
spelled-out addresses, split numbers. Base spans always stay; an added span never overlaps one.

A word's scores depend on its surroundings, of which few differ, so they are computed once for each. Where they favour "no
personal data" by more than any change of labels before and behind could outweigh, that is the word's label on the best path; Viterbi runs over
the stretches between such words. So the labels are those of one pass over the whole text.

Cases: a null or empty text has no spans; positions are code points, ends exclusive; repeated rows get
equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import mixed, slices, small_batches
from tracemill.llm.crf import ChainField

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMERIC = re.compile(r"[0-9][0-9 .-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for run in _NUMERIC.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:3] or "0") <= 255 for x in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# Words that stand before personal data.
CUES = ("call", "phone", "tel", "mobile", "fax", "text", "mail", "email", "contact", "write", "at", "dot", "card", "visa", "credit", "ip", "host", "address", "server", "from", "version", "order", "page", "token")
# The labelled table: a word, or a word with its kind after a bar; # stands for a random digit.
TRAINING = (
    "call 0###|phone #######|phone today", "phone: (###)|phone ###-####|phone or later", "tel ###-###-####|phone ext", "my mobile is ###.###.####|phone thanks", "fax (0##)|phone ####|phone ####|phone",
    "00##|phone ##|phone #######|phone is the number", "text me on ####-######|phone please", "call ##########|phone",
    "mail jane|email dot|email doe|email at|email example|email dot|email com|email now", "write to bob|email at|email mail|email dot|email org|email", "contact amy|email [at]|email site|email [dot]|email net|email for more", "email: joe|email (at)|email corp|email (dot)|email com|email",
    "card ####|card ####|card ####|card ####|card ok", "visa ####-####|card ####-####|card was charged", "credit card: ######|card ######|card ####|card end", "pay with ####/####/####/####|card",
    "host ###|ip .|ip ##|ip .|ip #|ip .|ip ##|ip is down", "ip ##-##-###-#|ip from", "server address ##,|ip ##,|ip ##,|ip ##|ip",
    "in #### there were ### of them", "version #.#.# came out on ##/##/####", "page ## of ###", "order #####-## costs #.## or #,###", "token = \"#a#b##c#d###e\" was here", "licensed under cc by-nc #.#", "version # of the text", "the ### words and ## lines, then the rest",
    "at ##:## on the ##th of may ####", "that is at the end of it", "a dot and a line at home", "the mail at noon", "id ################ in the log", "hash #########", "###### items at ##.# each", "see section #.#.#.#. of it", "the number ######### is large", "it was ####-##-## at ##:##:##",
)
LABELS = ("none", *KINDS)


def shape(word: str) -> str:
    """Letters as x or X, digits as 9; letter runs are shortened to two, digit runs keep their length up to 6."""
    core = word.rstrip(".,;:!?")
    if core.isalpha():  # most words; the same in fewer steps
        if core.islower():
            return "xx"[: len(core)] + word[len(core) :]
        if core[0].isupper() and core[1:].islower():
            return "X" + "xx"[: len(core) - 1] + word[len(core) :]
    out = re.sub(r"[0-9]", "9", word)
    out = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", out)
    out = re.sub(r"(x|X)\1{2,}", r"\1\1", out)
    return re.sub(r"9{7,}", "9999999", out)


def _cue(word: str) -> str:
    low = word.lower().strip(".,:;()[]")
    return low if low in CUES else ""


_CUE_NAMES = ("", "^", *CUES)
_CUE_NUMBERS = {c: n for n, c in enumerate(_CUE_NAMES)}


def _feature(s: str, s0: str, s1: str, c: str, c0: str, c1: str, c2: str) -> tuple[str, ...]:
    """Features of a word by its shape, those before and behind, and its cue, those before and behind, and that before the one before."""
    return (f"s={s}", f"c={c}", f"-={s0}", f"+={s1}", f"-c={c0}", f"+c={c1}", f"-2c={c2}", f"d={min(7, s.count('9'))}", f"s-={s0}|{s}", "bias")


def features(words: list[str]) -> list[tuple[str, ...]]:
    shapes, cues = ["^", *map(shape, words), "^"], ["^", "^", *map(_cue, words), "^"]
    return [_feature(shapes[i + 1], shapes[i], shapes[i + 2], cues[i + 2], cues[i + 1], cues[i + 3], cues[i]) for i in range(len(words))]


@functools.lru_cache(1)
def trained() -> ChainField:
    """The field, trained from TRAINING with eight draws of the digits; the same on every machine."""
    rng = np.random.default_rng(11)
    sequences, tags = [], []
    for row in TRAINING:
        for _ in range(8):
            pairs = [w.rpartition("|") if "|" in w else (w, "", "none") for w in row.split()]
            words = ["".join(str(rng.integers(10)) if c == "#" else c for c in w) for w, _, _ in pairs]
            sequences.append(features(words))
            tags.append([LABELS.index(k) for _, _, k in pairs])
    return ChainField(LABELS).fit(sequences, tags)


_TOKEN = re.compile(r"\S+")


def _valid(kind: str, body: str) -> bool:
    digits = _DIGIT.findall(body)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn("".join(digits))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", body)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    low = body.lower()
    return ("@" in body or re.search(r"[\[(\s]at[\])\s]", low) is not None) and ("." in body or "dot" in low)


class Tagger:
    """Labels of all words of texts.

    The numbers of words and the scores of surroundings are kept from text to text, until there are more than MOST of either or their
    words and shapes have more than MOST_CHARS characters.
    """

    MOST, MOST_CHARS = 300_000, 32 << 20

    def __init__(self, field: ChainField):
        self.field = field
        # no path gains more than this by another label at one word
        self.bound = 2 * float(field.moves.max() - field.moves.min())
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.shapes, self.names = {"^": 0}, ["^"]
        self.known: dict[int, int] = {}
        self.scores = np.zeros((1024, len(LABELS)))
        self.chars = 0

    def _number(self, word: str) -> int:
        """The word's shape and cue as one number."""
        s = shape(word)
        self.chars += len(word)
        if s not in self.shapes:
            self.shapes[s] = len(self.names)
            self.names.append(s)
            self.chars += len(s)
        self.words[word] = n = self.shapes[s] * 32 + _CUE_NUMBERS[_cue(word)]
        return n

    def _scores(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of each label for each word of texts that stand in a row."""
        n, ends = len(numbers), np.cumsum(counts)
        place = np.arange(n) - np.repeat(ends - counts, counts)
        left = np.repeat(counts, counts) - 1 - place

        def near(d: int) -> np.ndarray:
            out = np.full(n, _CUE_NUMBERS["^"], np.int64)  # shape 0 is the edge
            inside = (place + d >= 0) & (left - d >= 0)
            at = np.flatnonzero(inside)
            out[at] = numbers[at + d]
            return out

        before, behind, second = near(-1), near(1), near(-2) & 31
        key = np.zeros(n, np.uint64)
        for part in (before, numbers, behind, second):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        new = [i for i, k in enumerate(distinct.tolist()) if k not in self.known]
        rows, have = [], len(self.known)
        for i in new:
            self.known[int(distinct[i])] = have + len(rows)
            at = first[i]
            s, s0, s1 = (self.names[x >> 5] for x in (int(numbers[at]), int(before[at]), int(behind[at])))
            c, c0, c1, c2 = (_CUE_NAMES[x & 31] for x in (int(numbers[at]), int(before[at]), int(behind[at]), int(second[at])))
            rows.append(self.field.score(_feature(s, s0, s1, c, c0, c1, c2)))
        if rows:
            if have + len(rows) > len(self.scores):  # doubled, so that growth costs no more than the rows
                self.scores = np.concatenate([self.scores, np.zeros((max(len(rows), len(self.scores)), len(LABELS)))])
            self.scores[have : have + len(rows)] = rows
        return self.scores[np.array([self.known[k] for k in distinct.tolist()], np.int64)[back]] if n else self.scores[:0]

    def tags(self, texts: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """(text, first word, labels) of the stretches of words in which a label may be other than none."""
        if max(len(self.words), len(self.known)) > self.MOST or self.chars > self.MOST_CHARS:
            self.clear()
        split = [t.split() for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        known, number = self.words, self._number
        numbers = np.fromiter((known[w] if w in known else number(w) for words in split for w in words), np.int64, int(counts.sum()))
        scores = self._scores(numbers, counts)
        text = np.repeat(np.arange(len(texts)), counts)
        start = np.cumsum(counts) - counts
        open_ = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(1) <= self.bound)
        if not len(open_):
            return []
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(text[open_]) > 0)) + 1
        where, stretches = [], []
        for a, b in zip(open_[np.concatenate([[0], cut])], open_[np.concatenate([cut - 1, [len(open_) - 1]])] + 1, strict=True):
            n = text[a]
            low, high = max(a - 1, start[n]), min(b + 1, start[n] + counts[n])
            own = scores[low:high].copy()
            for edge in {low, high - 1} - set(range(a, b)):  # the words around are labelled none
                own[edge - low, 1:] = -1e9
            where.append((int(n), int(low - start[n])))
            stretches.append(own)
        return [(n, first, tags) for (n, first), tags in zip(where, self.field.decode_scores(stretches), strict=True) if tags.any()]


def added_spans(texts: list[str], bases: list[list[tuple[int, int, str]]], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """What the field finds beside the base spans of each text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    tokens: dict[int, list[tuple[int, int]]] = {}
    for n, first, tags in tagger.tags(texts):
        if n not in tokens:
            tokens = {n: [m.span() for m in _TOKEN.finditer(texts[n])]}  # stretches of a text come together
        i = 0
        while i < len(tags):
            j = i + 1
            while j < len(tags) and tags[j] == tags[i]:
                j += 1
            if tags[i]:
                a, b = tokens[n][first + i][0], tokens[n][first + j - 1][1]
                while a < b and texts[n][a] in ".,;:!?\"'":
                    a += 1
                while a < b and texts[n][b - 1] in ".,;:!?\"'":
                    b -= 1
                kind = LABELS[tags[i]]
                if _valid(kind, texts[n][a:b]) and not any(a < y and x < b for x, y, _ in bases[n]):
                    out[n].append((a, b, kind))
            i = j
    return out


def _scan(batches: Iterator[pa.RecordBatch], field: ChainField) -> Iterator[pa.RecordBatch]:
    tagger = Tagger(field)
    for batch in batches:
        column = batch.column("__text").cast(pa.string()).fill_null("")
        for x, y in slices(column):
            texts = column.slice(x, y - x).to_pylist()
            bases = [base_spans(t) for t in texts]
            spans = [sorted(b + m, key=lambda s: (s[0], KINDS.index(s[2]))) for b, m in zip(bases, added_spans(texts, bases, tagger), strict=True)]
            counts = [pa.array([sum(s[2] == k for s in b) for b in bases], pa.int64()) for k in KINDS]
            sums = [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases]
            yield pa.RecordBatch.from_arrays([batch.column("__id").slice(x, y - x), *counts, pa.array(sums), pa.array([joined(s) for s in spans], pa.string())], ["__id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (base and added). No shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind, field = dict(rows.dtypes)["__id"], trained()
    field.memo.clear()
    out = rows.mapInArrow(lambda batches: _scan(batches, field), f"__id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    return out.withColumnRenamed("__id", id_col)
