import zlib

import corpus_pipeline
import numpy as np
from test_decontaminate import brute as leaks
from test_ngram_join import brute as groups
from test_token_files import brute as tokens

from tracemill.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    model = quality.train(docs, labels)
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs, model).collect()}

    first = corpus_pipeline.good_quality(spark, docs, SF)
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == {k for k, v in verdict.items() if v}
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]

    second = corpus_pipeline.one_of_near_copies(spark, first, SF)
    assert second.columns == columns
    assert sorted(r["doc_id"] for r in second.collect()) == [k for k, _, c in sorted(groups(rows), key=lambda r: r[0]) if k == c]
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]

    third = corpus_pipeline.without_leaks(spark, second, SF)
    exact = [(r["item_id"], r["text"]) for r in items.collect()]
    kept = {r["doc_id"] for r in third.collect()}
    for key, text in rows:
        holds = any(" ".join(t.lower().split()) in " ".join(text.lower().split()) for _, t in exact)
        assert (key not in kept) or not holds
    short = [(k, t) for k, t in rows if len(t) < 400][:6]
    assert {k for k, found, _ in leaks(short, exact) if not found} == kept & {k for k, _ in short}

    fourth = corpus_pipeline.mixed(spark, third, SF)
    assert fourth.columns == columns
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(third).collect()}
    rows = [(r["doc_id"], r["text"]) for r in fourth.collect()]
    assert sum(len(t.encode().split()) for _, t in rows) == sum(plan.values())

    want, got = tokens(rows), {}
    for r in corpus_pipeline.token_ids(spark, fourth, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    assert len({name for name, _ in corpus_pipeline.STAGES}) == 5 and zlib.crc32(b"") == 0 and np.all([r["n_tokens"] > 0 for r in rows])


def test_hard_tables(spark, tmp_path):
    """Nulls, repeats, clashing and dotted names and an empty table go through all stages; columns stay."""
    good = [" ".join("bcdfghklmnprstvwxz"[(n * 7 + i * 5) % 18] + "aeiou"[(n + i) % 5] + "lmnrst"[(n * i) % 6] + "ing"[: i % 4] for i in range(24)) for n in range(20)]
    rows = [(n, t, "en", "a", len(t), 1, "x") for n, t in enumerate(good)] + [(0, good[0], "en", "a", 1, 1, "x"), (50, good[3], "en", None, 1, 2, "y"), (None, good[4] + " or so", None, None, None, None, None), (51, None, None, "b", None, None, None), (52, "", "en", "b", 0, 1, "x"), (53, "word " * 20000, "en", "b", 1, 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, __row string"
    spark.createDataFrame([(0, good[1][:60])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema).repartition(3)
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), schema)
        kept = [r["doc_id"] for r in docs.collect()]
        assert 1 not in kept and 51 not in kept and 53 not in kept and 50 not in kept
        assert not given or {5, 6, 7, 8} <= set(kept)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.count() == len(kept)
