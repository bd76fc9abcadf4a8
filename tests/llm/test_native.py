import pyarrow as pa
import pytest
from oracle import agree

from tracemill.llm import chat, licenses, mixing, queries

SF = "/root/testdata/sf0.001"
DOCS = [
    (1, "Released under the MIT Licence!\nsome words", "a"),
    (2, "(c) 2020 Somebody\nReleased under the MIT License.", "a"),
    (2, "(c) 2020 Somebody\nReleased under the MIT License.", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, "!!! \n ???", "é"),
    (6, "LICENSED UNDER CC BY-NC 4.0\n" + "word " * 30000, "b"),
    (None, "no id here at all", None),
    (7, "x y z", "ab"),
    (7, "another text of the id", "ab"),
    (8, "Copyright line\nCopyright again\nLicensed under the Apache License, Version 2.0.", None),
]
CHATS = [
    (1, 0, "user", "hi"),
    (2, 0, "user", "hi"),
    (2, 1, "assistant", "hello <|im_end|>"),
    (3, 0, "user", "hi"),
    (3, 1, "assistant", "hello <|im_end|>"),
    (3, 2, "user", "more"),
    (4, 5, "user", "hi"),
    (4, 6, "assistant", "hello <|im_end|>"),
    (4, 7, "user", "more"),
    (5, 0, None, None),
    (5, 0, None, None),
    (6, 0, "user", "other"),
    (6, 0, "user", "same number"),
    (7, None, "user", "no number"),
    (8, 0, "user", "long " * 20000),
]


def fixture(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    names = [c.split()[0] for c in schema.split(", ")]
    return df, pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})


@pytest.mark.parametrize("name,table", [("op3_license_scan", "documents"), ("op5_mix_sources", "documents"), ("op6_chat_format", "conversations")])
def test_registered_queries_match_sql(spark, name, table):
    agree(queries.QUERIES[name](spark, SF), queries.ORACLE[name], **{table: f"{SF}/{table}.parquet"})


def test_hard_documents(spark):
    df, table = fixture(spark, DOCS, "doc_id long, text string, source string")
    wide = df.selectExpr("*", "1 as size", "'x' as target", "2 as __n")
    agree(licenses.license_scan(wide), licenses.oracle_sql(), documents=table)
    agree(mixing.mix_plan(wide), mixing.ORACLE_SQL, documents=table)
    assert not licenses.license_scan(df.limit(0)).collect() and not mixing.mix_plan(df.limit(0)).collect()


def test_hard_chats(spark):
    df, table = fixture(spark, CHATS, "conv_id long, turn long, role string, text string")
    agree(chat.format_chats(df.selectExpr("*", "1 as n_turns", "2 as chat")), chat.ORACLE_SQL, conversations=table)
    assert not chat.format_chats(df.limit(0)).collect()
    nobody = spark.createDataFrame([(None, 0, "user", "no conversation")], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.format_chats(nobody).collect()] == [None]


def test_license_kinds(spark):
    df, _ = fixture(spark, DOCS, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert got[1]["line_licenses"] == "MIT" and got[1]["text_license"] is None
    assert got[2]["text_license"] == "MIT" and got[8]["text_license"] == "Apache-2.0"
    assert got[6]["n_license_lines"] == 1 and got[5]["n_license_lines"] == 0


def test_known_texts_as_a_table(spark):
    df, _ = fixture(spark, DOCS, "doc_id long, text string, source string")
    known = spark.createDataFrame([*licenses.KNOWN, ("Own", "x, Y; z"), ("Own", None), ("Own", "!!")], "a string, b string")
    got = {r["doc_id"]: r for r in licenses.license_scan(df, known).collect() if r["text_license"] or r["doc_id"] == 1}
    assert got[1]["line_licenses"] == "MIT" and got[7]["text_license"] == "Own"
    names = {n for n, _ in licenses.KNOWN}
    whole = spark.createDataFrame([(n, t.upper().replace(".", " .\n")) for n, t in licenses.KNOWN], "doc_id string, text string")
    assert {r["text_license"] for r in licenses.license_scan(whole).collect()} == names


def test_mix_repeats_rows_as_planned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r["doc_id"]: r for r in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for key, row in plan.items():
        assert row["taken"] == row["size"] * times.get(key, 0) if row["size"] else True
    by_source = {}
    for row in mixing.mix_plan(docs.where("source is not null")).collect():
        by_source.setdefault((row["source_size"], row["target"]), [0, 0])[0] += row["taken"]
    largest = max(r["size"] for r in plan.values())
    assert all(abs(taken - target) <= largest for (_, target), (taken, _) in by_source.items())


def test_targets_stop_at_caps(spark):
    sizes = spark.createDataFrame([("aa", 10), ("ab", 1000), ("ac", 50), ("ad", 0)], "__s string, __size long")
    got = {r["__s"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["aa"] == 20 and got["ac"] == 100 and got["ad"] == 0
    assert abs(sum(got.values()) - 1.5 * 1060) < 1e-6 and got["ab"] <= 2000


def test_mix_with_clashing_columns(spark):
    names = ["doc_id", "target", "__size", "source_size", "__s", "text", "__reps", "source", "c0", "Target_"]
    rows = [(i, i * 10, f"s{i}", i * 2, None, "word " * (1 + i % 7), i, f"src{i % 3}", "x", i) for i in range(60)]
    docs = spark.createDataFrame(rows, names[0] + " long, target int, __size string, source_size int, __s string, text string, __reps int, source string, c0 string, Target_ int")
    mixed = mixing.mix(docs)
    assert mixed.columns == names and mixed.dtypes == docs.dtypes
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_plan(docs).collect()}
    got = sorted(tuple(r) for r in mixed.collect())
    assert got == sorted(r for r in rows for _ in range(times[r[0]]))
