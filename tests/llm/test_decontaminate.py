import random
import re

from tracemill.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def brute(docs, items, rate=16, least=0):
    items = [(k, dc.normalized(t)) for k, t in items if k is not None and t is not None]
    out = []
    for key, text in docs:
        plain = dc.normalized(text or "")
        found = [(k, d) for k, t in items if len(t) >= max(1, least) and (d := slow_distance(t, plain)) <= len(t) // rate]
        found += [(k, 0) for k, t in items if 0 < len(t) < least and re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", plain)]
        out.append((key, [k for k, _ in sorted(found)], [d for _, d in sorted(found)]))
    return sorted(out, key=str)


def result(df):
    rows = df.collect()
    assert all(r["leaked"] == bool(r["item_ids"]) and r["n_items"] == len(r["item_ids"]) for r in rows)
    return sorted(((r["doc_id"], r["item_ids"], r["distances"]) for r in rows), key=str)


def test_myers_matches_plain_distance():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, 90))) for lo in (1, 0))
        assert dc.distance_within(dc.masks(a), len(a), b) == slow_distance(a, b)


def test_hard_rows_and_blocks(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("mor", "tel", "vin", "das") for b in ("ak", "ip", "on", "ule", "e")]
    item = " ".join(rng.choice(words) for _ in range(30))
    k = len(item) // 16
    edit = list(item)
    for i in range(k):
        edit[16 * i + 5] = "#"
    items = [(1, item), (2, item.upper()), (3, "short"), (4, None), (None, item), (5, " ".join(rng.choice(words) for _ in range(25)))]
    far = list(edit)
    far[2] = "#"
    docs = [(1, "x " + item.replace(" ", "\n ")), (2, "".join(edit)), (3, "".join(far)), (4, None), (5, ""), (6, items[5][1] + " y " + item), (6, items[5][1] + " y " + item), (None, item[1:]), (7, "filler " * 3000 + item), (8, item[: len(item) // 2])]
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n_items int, item_ids string").repartition(3)
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    want = brute([d for d in docs if d[0] != 7], items) + [(7, [1, 2], [0, 0])]
    assert result(dc.leaks(frame, table)) == sorted(want, key=str)
    assert result(dc.leaks(frame, table, block_chars=100)) == sorted(want, key=str)
    assert sorted(r["doc_id"] for r in dc.keep_clean(frame, table, block_chars=100).collect()) == [3, 4, 5, 8]
    assert dc.keep_clean(frame, table).columns == frame.columns
    assert result(dc.leaks(frame, table.limit(0))) == sorted([(k, [], []) for k, _ in docs], key=str)
    assert dc.keep_clean(frame, table.limit(0)).count() == len(docs)
    assert not dc.leaks(frame.limit(0), table).collect()


def test_short_items_and_ids_of_other_types(spark):
    items = [("a", "yes"), ("b", "42"), ("c", ""), ("d", "  "), ("e", "of it")]
    docs = [(1, "Yes."), (2, "yesterday 142"), (3, "is it 42?"), (4, "most  of\nit"), (5, "of item"), (6, None)]
    frame, table = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert result(dc.leaks(frame, table)) == brute(docs, items)
    assert result(dc.leaks(frame, table)) == [(1, ["a"], [0]), (2, ["a", "b"], [0, 0]), (3, ["b"], [0]), (4, ["e"], [0]), (5, ["e"], [0]), (6, [], [])]
    # as whole words, if asked
    assert result(dc.leaks(frame, table, word_chars=20)) == brute(docs, items, least=20) == [(1, ["a"], [0]), (2, [], []), (3, ["b"], [0]), (4, ["e"], [0]), (5, [], []), (6, [], [])]
    assert result(dc.leaks(frame, table, block_chars=3)) == result(dc.leaks(frame, table))
    assert sorted(r["doc_id"] for r in dc.keep_clean(frame, table, word_chars=20).collect()) == [2, 5, 6]


def test_items_of_any_length_have_their_budget(spark):
    """One edit for each 16 characters: items of 15 to 33 characters, with one edit more and one less than that."""
    letters = "the quick brown fox jumps over the lazy dog"
    items = [(n, letters[:n].strip()) for n in range(15, 34)]
    docs = []
    for n, text in items:
        for edits in range(4):
            spoilt = list(text)
            for i in range(edits):
                spoilt[3 + 5 * i] = "#"
            docs.append((100 * n + edits, "".join(spoilt)))
    frame, table = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert result(dc.leaks(frame, table)) == brute(docs, items)


def test_column_names_with_dots(spark):
    frame = spark.createDataFrame([(1, "abcdefghijklmnopqrst", 2, 3), (2, "other", 2, 3)], "doc_id int, text string, `a.b` int, `__text` int")
    table = spark.createDataFrame([(1, "abcdefghijklmnopqrst")], "item_id int, text string")
    kept = dc.keep_clean(frame, table)
    assert kept.columns == frame.columns
    assert [r["doc_id"] for r in kept.collect()] == [2]

def test_finds_planted_passages(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    passages = [(r["item_id"], dc.normalized(r["text"])) for r in items.collect()]
    got = {r["doc_id"]: r["item_ids"] for r in dc.leaks(docs, items).collect()}
    for r in docs.collect():
        text = dc.normalized(r["text"] or "")
        assert {k for k, t in passages if t in text} <= set(got[r["doc_id"]])
