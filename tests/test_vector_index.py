"""The vector index as a table: refreshed piecewise it equals one built at once."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import retrieval, vector_index

SCHEMA = "vec_id long, group string, embedding array<float>"
DIMS = 32


def vectors(rng, n):
    return {i: (f"repo{rng.randint(0, 5)}", [rng.uniform(-1, 1) for _ in range(DIMS)]) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(i, g, v) for i, (g, v) in rows.items()], SCHEMA)


def content(df):
    return sorted((r["vec_id"], r["group"], tuple(r["code"]), r["z"]["scale"], tuple(r["z"]["q"])) for r in df.collect())


def test_refreshes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    rows = vectors(rng, 60)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"), DIMS, 8)
    assert index.read(frame(spark, rows)).count() == 0
    assert index.refresh(frame(spark, rows)) == 60
    for _ in range(3):
        before = dict(rows)
        for i in rng.sample(sorted(rows), 6):
            change = rng.random()
            if change < 0.3:
                del rows[i]
            elif change < 0.6:
                rows[i] = (rows[i][0], [rng.uniform(-1, 1) for _ in range(DIMS)])
            else:
                rows[i] = (f"repo{rng.randint(0, 9)}", rows[i][1])
        rows[max(rows) + 1] = ("repo1", [0.5] * DIMS)
        changed = sum(before.get(i) != r for i, r in rows.items())
        df = frame(spark, rows)
        assert index.refresh(df) == changed
        assert index.refresh(df) == 0
        assert content(index.read(df)) == content(retrieval.encoded(df, DIMS))
    only = {i: r for i, r in rows.items() if r[0] == "repo1"}
    index.refresh(frame(spark, only))
    assert content(index.read(frame(spark, only))) == content(retrieval.encoded(frame(spark, only), DIMS))


def test_search_reads_the_groups_asked_for(spark, tmp_path):
    rng = random.Random(6)
    rows = vectors(rng, 400)
    df = frame(spark, rows)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"), DIMS, 16)
    index.refresh(df)
    queries = df.where("vec_id % 40 = 0 AND group IN ('repo1', 'repo2')").select(F.col("vec_id").alias("query_id"), "group", "embedding")
    found = index.search(queries)
    show = lambda x: sorted(map(tuple, x.select("query_id", "vec_id", "distance", "cosine", "rank").collect()))
    assert show(found) == show(retrieval.vector_search(df, queries, DIMS))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    # what may not be shown goes after the search has fetched more than it needs
    shown = df.where("vec_id % 3 <> 0")
    some = index.search(queries, shown, top=5)
    wide = {}
    for q, v, _, c, _ in show(retrieval.vector_search(df, queries, DIMS, top=25)):
        wide.setdefault(q, []).append((-c, v))
    want = sorted((q, v) for q, x in wide.items() for _, v in [p for p in sorted(x) if p[1] % 3][:5])
    assert sorted((r["query_id"], r["vec_id"]) for r in some.collect()) == want


@pytest.mark.parametrize("empty", [True, False])
def test_nothing_to_find(spark, tmp_path, empty):
    df = frame(spark, {} if empty else {1: ("a", [1.0] * DIMS)})
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"), DIMS)
    index.refresh(df)
    queries = spark.createDataFrame([(1, "other", [1.0] * DIMS)], SCHEMA.replace("vec_id", "query_id"))
    assert index.search(queries).count() == 0
