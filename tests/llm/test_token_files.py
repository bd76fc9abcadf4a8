import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tracemill.llm import token_files as tf


def brute(rows):
    tok = Tokenizer.from_file(tf.tokenizer_path())
    out, start = {}, 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.setdefault(key, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def check(docs, rows):
    want, got = brute(rows), {}
    for r in tf.tokenize_and_read(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_hard_rows(spark):
    rows = [(5, "It's <|endoftext|> or <|ENDOFTEXT|>"), (2, None), (1, ""), (9, "É é é  x\x1cy ﬁ 12.5% 日本語 🙂"), (None, "no id"), (7, "same same"), (7, "same same"), (3, "word's " * 20000), (4, " \n\t ")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pos int, before string").repartition(3)
    check(docs, rows)
    assert not tf.tokenize_and_read(docs.limit(0)).collect()


def test_files_are_ordered_and_skippable(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "t")
    tf.write_tokens(docs, path)
    rows = [r["doc_id"] for r in tf.read_tokens(spark, path).orderBy("file", "pos").collect()]
    assert rows == sorted(rows) and len(rows) == docs.count()
    found = tf.lookup(spark, path, [3, 77])
    assert sorted(r["doc_id"] for r in found.collect()) == [3, 77]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_starts_over_many_files(spark, tmp_path):
    rows = [(i, f"text number {i} of these " * (i % 5)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {k: v[0] for k, v in brute(rows).items()}
    got = lambda path: {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tf.token_digest(spark, path).collect()}

    # part numbers beyond five digits
    path = tmp_path / "t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tf.write_tokens(docs, str(path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got(str(path)) == want
    parts = sorted(path.glob("part-*.orc"))
    for n, p in enumerate(parts):
        p.rename(path / p.name.replace(p.name[:10], f"part-{99999 + n:05}", 1))
    assert len(parts) > 1 and got(str(path)) == want

    # parts cut into several files
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        tf.write_tokens(docs, str(tmp_path / "u"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "u").glob("part-*.orc"))) > 10 and got(str(tmp_path / "u")) == want


def encoded(texts, size=1000):
    """What tasks make of texts in batches of this size, and their encoder."""
    tf._encoder.cache_clear()
    batches = pa.table({"__id": pa.array(range(len(texts)), pa.int64()), "__text": pa.array(texts, pa.string())}).to_batches(max_chunksize=size)
    ids = [r for b in tf._encode(tf.TOKENIZER, 1, None)(iter(batches)) for r in b.column("ids").to_pylist()]
    return ids, tf._encoder(tf.tokenizer_path())


def whole(texts):
    tok = Tokenizer.from_file(tf.tokenizer_path())
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_words_are_encoded_once_whatever_marks_follow():
    words = [a + b + "ing" for a in ("th", "ch", "é", "or", "st") for b in "aeiouyäöüß"]
    texts = [" ".join(w + m for w in words) for m in ("", ",", ".", "$$$", "!!", ".%%%", "'", "-")]
    ids, encoder = encoded(texts)
    assert ids == whole(texts)
    assert len(encoder.known) <= len(words) + 8


def test_full_table_keeps_frequent_words(monkeypatch):
    monkeypatch.setattr(tf, "MOST_WORDS", 100)
    rare = lambda c: " ".join(c + a + b for a in "abcdefghijklm" for b in "nopqrstuvwxyz")
    texts = ["often, " * 50 + rare("a"), rare("b"), "often seen", rare("c"), None, rare("b") + " often."]
    ids, encoder = encoded(texts[:2], 1)
    assert b"often" in encoder.known and len(encoder.known) < 300
    assert encoded(texts, 1)[0] == whole(texts)


def test_pieces_join_to_whole_texts():
    rng = np.random.default_rng(4)
    parts = ["a", "ab", "'s", "'", "s", "E", "é", "é", "́", "İ", "Σ", "ﬁ", "क़", "–", "½", "5", "²", "日本", "🙂", ".", ",", "$$$", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "̸", "<", " ", "\n", "\x1c", "\x85", " ", "　", "‍", "_"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(6000)]
    assert encoded(texts)[0] == whole(texts)
