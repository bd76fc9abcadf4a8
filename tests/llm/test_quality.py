import re
import zlib
from collections import Counter

import numpy as np

from tracemill.llm import quality, toxicity, trees

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    gone = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(gone), n < 10 or 100 * len(gone) > 20 * n)


def check(docs, model):
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    got = sorted(quality.judge(docs, model).collect(), key=lambda r: str((r["doc_id"],)))
    assert sorted(str((k, *brute(t))) for k, t in texts) == sorted(str((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"])) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    return got


def test_counts_and_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in check(docs, model)}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [got[r["doc_id"]]["score"] >= 0.5 for r in held if r["quality"] == 1], [got[r["doc_id"]]["score"] < 0.5 for r in held if r["quality"] == 0]
    assert np.mean(right[0]) > 0.95 and np.mean(right[1]) > 0.85, [np.mean(x) for x in right]


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c d e " * 10), (3, "é# " * 30 + "\nx\nx\n \n \nx "), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (5, " ".join(f"w{i}" for i in range(100000))), (6, "<<>>&&|| \x1c x"), (7, "a\r\nb\r\na\r\n")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `kept.x` string, n_words int").repartition(3)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    check(docs, model)
    assert not quality.judge(docs.limit(0), model).collect()
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5}
    odd = spark.createDataFrame([(None, 1), (4, None), (4, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    assert quality.train(docs, odd).score(np.zeros((1, len(quality.FEATURES)))).shape == (1,)


def test_constraints_hold():
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(600) > 0.5).astype(float)
    model = trees.fit(x, y, (-1, 0, 1))
    line = np.repeat(rng.random((50, 3)), 20, 0)
    line[:, 0] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(model.score(line).reshape(50, 20), axis=1) <= 1e-12).all()
    free = trees.fit(x, y, (1, 0, 0))
    assert ((free.score(x) > 0.5) == (y > 0.5)).mean() > 0.8


def test_text_ids(spark):
    rows = [(f"id{i}", ("good words of a text that goes on and on for a while " if i % 2 else "# # $ $ | | ! ! a b c ") * 3 + str(i), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(k, y, y) for k, _, y in rows], "doc_id string, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert min(got[k] for k, _, y in rows if y) > 0.5 > max(got[k] for k, _, y in rows if not y)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert {r["doc_id"] for r in scored} == {r[0] for r in rows}
