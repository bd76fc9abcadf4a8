"""The search by sign codes against plain Python, with groups dealt to parts and chunks, and with odd vectors."""

import random

from pyspark.sql import functions as F

from tracemill.operators import nearest, retrieval

SCHEMA = "vec_id long, group string, embedding array<float>"
DIMS = 40


def brute(rows, queries, most, top):
    """(query_id, vec_id, distance, cosine, rank); rows and queries: (id, group, embedding)."""
    code = lambda x: [bool(x and i < len(x) and x[i] is not None and x[i] >= 0) for i in range(DIMS)]

    def cosine(y, x):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return None
        scale, total = max(map(abs, y)) / 127, 0.0
        for a, b in zip(y, x, strict=True):
            total += int(abs(a / scale) + 0.5) * (1 if a >= 0 else -1) * b
        return round(total * scale, 6)

    out = []
    for q, g, x in queries:
        found = sorted((sum(a != b for a, b in zip(code(x), code(y), strict=True)), v, cosine(y, x)) for v, h, y in rows if g is not None and g == h)[:most]
        order = sorted(found, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))[:top]
        out += [(q, v, d, c, n + 1) for n, (d, v, c) in enumerate(order)]
    return sorted(out)


def shown(df):
    return sorted(map(tuple, df.select("query_id", "vec_id", "distance", "cosine", "rank").collect()))


def test_parts_and_chunks_meet(spark, monkeypatch):
    rng = random.Random(9)
    base = [[rng.uniform(-1, 1) for _ in range(DIMS)] for _ in range(60)]
    rows = spark.createDataFrame([(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(base)) for i in range(700)] + [(900, "a", None), (901, "a", [0.5] * 7), (902, "a", [0.5, None] + [0.25] * 38), (903, "c", [0.5] * 7)], SCHEMA)
    asked = rows.where("vec_id % 5 = 0 OR vec_id >= 900").select(F.col("vec_id").alias("query_id"), "group", "embedding")
    want = brute(*([tuple(r) for r in x.collect()] for x in (rows, asked)), 30, 12)
    assert shown(retrieval.vector_search(rows, asked, DIMS, 30, 12)) == want
    for name, most in (("VECTORS", 50), ("QUERIES", 20), ("COMPARED", 16), ("ASKED", 7)):
        monkeypatch.setattr(nearest, name, most)
    assert shown(retrieval.vector_search(rows, asked, DIMS, 30, 12)) == want
    assert shown(retrieval.vector_search(rows, asked, DIMS, 30, 12, parts=3)) == want


def test_pairs_stay_in_their_task(spark):
    rows = spark.createDataFrame([(i, "a", [float(i % 7 - 3)] * DIMS) for i in range(1, 400) if i % 7 != 3], SCHEMA)
    asked = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), "group", "embedding")
    plan = retrieval.vector_search(rows, asked, DIMS, 10, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" not in plan and "MapInArrow" in plan  # no join whose rows are all pairs
