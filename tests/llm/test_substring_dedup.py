import hashlib
from collections import Counter

from tracemill.llm.substring_dedup import levels, substring_dedup


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_levels_double():
    assert levels(35) == [9, 18, 35]
    assert levels(5) == [5]


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(substring_dedup(docs)) == brute(rows, 35)


def test_hard_rows(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, passage),
        (2, f"a b\tc\n{passage}  d é x   y"),
        (3, passage.replace("w20", "other")),
        (4, None),
        (5, ""),
        (5, ""),
        (6, "a " * 50),
        (7, "b " * 35),
        (8, "c c " * 18),
        (None, passage),
        (9, "one row twice " * 12),
        (9, "one row twice " * 12),
        (9, "one id, other text"),
        (10, " ".join(f"v{i % 40}" for i in range(90))),
        (11, "\x1c " + " ".join(f"w{i}" for i in range(34))),
        (12, " ".join(f"long{i}" for i in range(60000)) + " " + passage),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_words string, __p int").repartition(5)
    assert result(substring_dedup(docs)) == brute(rows, 35)
    assert result(substring_dedup(docs.limit(0))) == []
