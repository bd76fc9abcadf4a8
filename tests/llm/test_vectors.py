"""Operators on vectors: near duplicates, clustering and whitening, against brute force."""

import hashlib
import math

import numpy as np
import pytest
from oracle import agree

from tracemill.llm import clustering, queries, vector_links, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [3.0]]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def near(rng, centre, n, cosine):
    """n unit vectors whose cosine with a centre is as stated."""
    away = rng.normal(size=(n, len(centre)))
    away = unit(away - (away @ centre)[:, None] * centre)
    return cosine * centre + math.sqrt(1 - cosine**2) * away


def planted(seed=3):
    rng = np.random.default_rng(seed)
    noise = unit(rng.normal(size=(600, 64)))
    tight = near(rng, noise[0], 300, 0.99)
    loose = near(rng, noise[1], 120, 0.955)
    chain = [noise[2]]
    for _ in range(40):
        chain.append(near(rng, chain[-1], 1, 0.92)[0])
    pairs = np.concatenate([near(rng, x, 1, c) for x, c in zip(noise[10:210], np.linspace(0.9001, 0.999, 200), strict=True)])
    copies = np.repeat(noise[300:302], 50, axis=0)
    return [x.astype(np.float32).tolist() for x in (*noise, *tight, *loose, *chain, *pairs, *copies)]


def brute_links(rows, threshold=0.9):
    ids = [r[0] for r in rows]
    good = [i for i, r in enumerate(rows) if r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    partners = {i: [] for i in range(len(rows))}
    for length in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == length]
        x = unit(np.array([rows[i][1] for i in own], float))
        c = x @ x.T
        for a, i in enumerate(own):
            partners[i] = [own[b] for b in np.flatnonzero(c[a] >= threshold - 1e-12) if b != a]
    seen, least = {}, {}
    for i in range(len(rows)):
        if i in seen:
            continue
        stack, seen[i] = [i], i
        while stack:
            for j in partners[stack.pop()]:
                if j not in seen:
                    seen[j] = i
                    stack.append(j)
    for i, root in seen.items():
        if ids[i] is not None:
            least[root] = min(least.get(root, ids[i]), ids[i])
    return sorted(((ids[i], len(partners[i]), least.get(seen[i])) for i in range(len(rows))), key=str)


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [2048, 64])
def test_links_equal_brute_force(spark, monkeypatch, block):
    """Families of all kinds, in one block or in many, in parts of a row or whole."""
    monkeypatch.setattr(vector_links, "BLOCK", block)
    monkeypatch.setattr(vector_links, "MOST_MEMBERS", block)
    monkeypatch.setattr(vector_links, "MOST_VISITORS", 4 * block)
    rows = [(i * 3 % 4001, x, i % 3) for i, x in enumerate(planted())]
    df = vector_links.near_vectors(spark.createDataFrame(rows, SCHEMA))
    got, want = result(df), brute_links(rows)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    # pairs just at the threshold may be missed by the index, two in a hundred; nothing else may
    assert len(wrong) <= 4, wrong[:5]
    assert sum(n for _, n, _ in got) >= 0.999 * sum(n for _, n, _ in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.92 among random vectors, the hardest there are."""
    rng = np.random.default_rng(11)
    noise = unit(rng.normal(size=(3000, 64)))
    pairs = np.concatenate([near(rng, x, 1, c) for x, c in zip(noise[:1000], np.linspace(0.9001, 0.92, 1000), strict=True)])
    rows = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate([*noise, *pairs])]
    got, want = (sum(r[1] for r in x) for x in (result(vector_links.near_vectors(spark.createDataFrame(rows, SCHEMA))), brute_links(rows)))
    assert want >= 1990
    assert got >= 0.97 * want


def test_links_of_odd_rows(spark):
    rows = [(i, x, None) for i, x in enumerate(ODD)] + [(7, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (None, None, 1), (20, [1e30] * 64, 1), (21, [1e-30] * 64, 1), (22, [1e30] * 64, 1)]
    assert result(vector_links.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute_links(rows)
    empty = vector_links.near_vectors(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    some = spark.createDataFrame([(1, [1.0, 0.0], 3, 4)], "vec_id long, embedding array<double>, `n_links` int, `a.b` int")
    assert [tuple(r) for r in vector_links.near_vectors(some).collect()] == [(1, 0, 1, True)]


def test_threshold_is_exact():
    """Cosines at the threshold count, whatever rounding makes of them."""
    x = np.array([[1.0, 0.0], [0.6, 0.8]])
    assert vector_links.linked(x, x, 0.6).all()


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        to = assign()
        for c in range(len(centroids)):
            own = [x for (_, x), (_, n) in zip(kept, to, strict=True) if n == c]
            if own:
                centroids[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    to = assign()
    total = sum(d for d, _ in to)
    by = {c: sum(d for d, n in to if n == c) for c in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, by[n], total, digest[n]) for (i, _), (d, n) in zip(kept, to, strict=True)), key=str)


def clusters(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(300, 64)) * np.linspace(3, 0.1, 64)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v in enumerate(ODD)] + [(5, x[5].tolist(), 1), (None, x[9].tolist(), 1)]
    df = clustering.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert clusters(df) == brute_clusters([r[:2] for r in rows])


def test_few_vectors_and_ties(spark):
    """Fewer vectors than clusters, equal ones among them; nothing at all; clashing names."""
    rows = [(i, [float(i // 2)] * 64, 0) for i in range(6)]
    assert clusters(clustering.cluster(spark.createDataFrame(rows, SCHEMA))) == brute_clusters([r[:2] for r in rows])
    for none in ([], [(i, v, 0) for i, v in enumerate(ODD[:2] + ODD[3:])]):
        assert clustering.cluster(spark.createDataFrame(none, SCHEMA)).collect() == []
    some = spark.createDataFrame([(1, [1.0] * 64, 3, 4)], "vec_id long, embedding array<double>, cluster int, `a.b` int")
    assert clusters(clustering.cluster(some)) == brute_clusters([(1, [1.0] * 64)])


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(8)
    x, c = rng.integers(-40, 40, (500, 64)), rng.integers(-40, 40, (16, 64))
    c[9] = c[4]
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    at, d = clustering.nearest(x, c, rng.permutation(64))
    assert (at == whole.argmin(1)).all()
    assert (d == whole.min(1)).all()


def test_large_entries_are_an_error():
    with pytest.raises(ArithmeticError):
        clustering.grid(np.array([[2.0**21]]), clustering.BITS)


def brute_whitening(rows, most=32):
    kept = [(i, [math.floor(64 * float(v)) + 1_000_000 for v in x]) for i, x in rows]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    z = np.array([[float(n * v - s) / n for v, s in zip(x, sums, strict=True)] for _, x in kept])
    v = z.T @ z / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    return {i: (sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), z[r] @ axes / np.sqrt(e)) for r, (i, x) in enumerate(kept)}, e / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(400, 64)) @ np.diag(np.linspace(2, 0.2, 64))).astype(np.float32)
    good = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000 + i, v, 0) for i, v in enumerate(ODD) if i != 2]  # zeros are a vector like any other here
    df = spark.createDataFrame(good + odd, SCHEMA).repartition(5)
    out = whitening.whiten(df).collect()
    want, explained = brute_whitening([r[:2] for r in good])
    assert len(out) == 400 * 32
    sign = {}
    for r in out:
        deviation, axis = want[r["vec_id"]]
        assert (r["n"], int(r["deviation"])) == (400, deviation)
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
        assert abs(r["whitened"]) == pytest.approx(abs(axis[r["component"] - 1]), rel=1e-6, abs=1e-6)
        if abs(r["whitened"]) > 0.01:
            assert sign.setdefault(r["component"], r["whitened"] * axis[r["component"] - 1] > 0) == (r["whitened"] * axis[r["component"] - 1] > 0)


def test_whitening_of_few_rows(spark):
    for rows in ([], [(1, [1.0] * 64, 0)], [(1, None, 0), (2, [], 0)], [(1, [1.0], 0), (1, [1.0], 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [2.0, 4.0], 0), (3, [9.0], 0)], SCHEMA)).collect()
    assert [(r["component"], r["n"], abs(round(r["whitened"], 9))) for r in out] == [(1, 2, 1.0)] * 2
    clash = spark.createDataFrame([(1, [1.0, 2.0], 3, 4), (2, [2.0, 1.0], 3, 4)], "vec_id long, embedding array<double>, n int, `a.b` int")
    assert whitening.whiten(clash).count() == 2


def test_moments_merge_as_if_at_once():
    x = np.random.default_rng(2).integers(-500, 500, (1000, 8)) + 10**4
    parts = [whitening.moments(p) for p in np.split(x, [1, 7, 500])]
    whole, have = whitening.moments(x), parts[0]
    for p in parts[1:]:
        have = whitening.merged(have, p)
    assert (have.n, have.sums) == (whole.n, whole.sums)
    assert np.allclose(have.scatter, whole.scatter, rtol=1e-9)


def test_deviation_beyond_longs():
    x = np.array([[2**40, -(2**40)]])
    assert whitening.deviation(x, 10**6, [5, -5]) == [2 * (10**6 * 2**40 - 5) ** 2]


@pytest.mark.parametrize("name", ["op11_near_vectors", "op12_cluster"])
def test_queries_equal_sql(spark, name):
    agree(queries.QUERIES[name](spark, SF), queries.ORACLE[name], embeddings=f"{SF}/embeddings.parquet")
