"""Word pieces and embeddings: texts as token rows, and their mean of token vectors by a join."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TOKENS, MOST_WORD_CHARS = 512, 100
# Blocks of characters that are words of their own.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def basic_words(value: str) -> list[str]:
    """Lower-case words without marks and control characters; punctuation and ideographs stand alone."""
    out = []
    for c in unicodedata.normalize("NFD", value.lower()):
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind == "Zs":
            out.append(" ")
        elif kind in ("Cc", "Cf", "Mn") or c in "\0\ufffd":
            continue
        else:
            alone = kind[0] == "P" or (c.isascii() and not c.isalnum()) or any(a <= ord(c) <= b for a, b in IDEOGRAPHS)
            out.append(f" {c} " if alone else c)
    return "".join(out).split()


def pieces(word: str, vocabulary: dict[str, int]) -> list[int]:
    """Longest pieces from the left; none for a word that the vocabulary can't make up."""
    out, start = [], 0
    while start < len(word) <= MOST_WORD_CHARS:
        end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in vocabulary), None)
        if end is None:
            return []
        out.append(vocabulary[("##" if start else "") + word[start:end]])
        start = end
    return out


def encoded(texts: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int]) -> DataFrame:
    """(id, pos, token): the first MOST_TOKENS word pieces of each text. The vocabulary (some 10^5 entries) is broadcast."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for frame in frames:
            rows = []
            for key, value in zip(frame["id"], frame["text"], strict=True):
                tokens: list[int] = []
                for word in basic_words(value):
                    if word not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[word] = pieces(word, shared.value)
                    tokens += known[word]
                    if len(tokens) >= MOST_TOKENS:
                        break
                rows += [(key, n, t) for n, t in enumerate(tokens[:MOST_TOKENS])]
            yield pd.DataFrame(rows, columns=["id", "pos", "token"])

    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, pos int, token int")


def embedded(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, embedding): the mean of the token vectors (token, scale, q), scaled to length one. Texts without tokens, or with a zero mean, have none."""
    parts = tokens.join(vectors, "token").select("id", "scale", F.posexplode("q").alias("at", "x"))
    sums = parts.groupBy("id", "at").agg(F.sum(F.col("scale") * F.col("x")).alias("x"))
    whole = sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return whole.where("norm > 0").select("id", F.transform("v", lambda p: p["x"] / F.col("norm")).alias("embedding"))
