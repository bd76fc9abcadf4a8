import zlib

import numpy as np

from tracemill.llm import gru, toxicity

SF = "/root/testdata/sf0.01"


def test_slopes_match_differences():
    net = gru.Network(20, 30)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x = rng.standard_normal((7, gru.WORD_DIM + gru.CHAR_DIM))
    at, real = rng.integers(0, 7, (3, 6)), np.arange(6)[None] < np.array([[6], [3], [1]])
    y, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss(x):
        z = net.run(net.projected(x), at, real).astype(float)
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / weight.sum())

    slopes, dx = net.slopes(x, at, real, y, weight)
    for table, grad in [(x, dx), *((net.p[k], slopes[k]) for k in ("wf", "ub", "gf", "v", "u", "b"))]:
        for i in rng.integers(0, table.size, 4):
            spot = np.unravel_index(i, table.shape)
            old, step = table[spot], 1e-2
            table[spot] = old + step
            high = loss(x)
            table[spot] = old - step
            low = loss(x)
            table[spot] = old
            assert abs((high - low) / (2 * step) - grad[spot]) < 2e-3


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 200])
    first = np.concatenate([[0], np.cumsum(counts)])
    for stride, back in ((1, 0), (24, 0), (24, 7)):
        text, start = toxicity.spread(counts, stride, back)
        for n, c in enumerate(counts):
            seen = {w for t, s in zip(text, start, strict=True) if t == n for w in range(s, min(s + toxicity.LENGTH, first[n] + c))}
            assert seen == set(range(first[n], first[n] + c))


def one_by_one(net, gates, rows, width, part=1024, warm=64):
    """Logits of the windows at each word of one text, a step at a time."""
    n, k = len(rows), gru.HIDDEN
    states = np.zeros((n, 2 * k))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for low in range(0, n, part):
        high = min(low + part, n)
        for way, side, steps in (("f", slice(0, k), range(max(0, low - warm), high)), ("b", slice(k, 2 * k), range(min(n, high + warm) - 1, low - 1, -1))):
            h = np.zeros(k)
            for t in steps:
                g, a = gates[way][rows[t]], h @ net.p[f"u{way}"]
                z, r = gru.LEAK + (1 - gru.LEAK) * sigmoid(g[:k] + a[:k]), sigmoid(g[k : 2 * k] + a[k : 2 * k])
                h = h + z * (np.tanh(g[2 * k :] + r * a[2 * k :]) - h)
                if low <= t < high:
                    states[t, side] = h
    out = []
    for s in range(n):
        own = states[s : s + width]
        share = np.exp(own @ net.p["v"])
        out.append(share @ own @ net.p["u"] / share.sum() + net.p["b"][0])
    return np.array(out)


def test_all_windows_match_steps_one_by_one():
    net, rng = gru.Network(20, 30), np.random.default_rng(4)
    net.p["v"], net.p["u"] = net.p["v"] * 4, net.p["u"] * 4
    gates = {way: rng.standard_normal((9, 3 * gru.HIDDEN)).astype(np.float32) for way in "fb"}
    counts = np.array([0, 1, 3, 8, 0, 9, 31, 40, 41, 100, 0])
    at = rng.integers(0, 9, counts.sum())
    edges = np.concatenate([[0], np.cumsum(counts)])
    for width, part, warm in ((8, 1024, 64), (32, 20, 6), (1, 7, 0), (4, 5, 9)):
        got = net.every(gates, at, counts, width, part, warm)
        want = np.concatenate([one_by_one(net, gates, at[a:b], width, part, warm) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a])
        assert np.allclose(got, want, atol=1e-4), np.abs(got - want).max()
    assert not len(net.every(gates, at[:0], np.zeros(3, int), 8))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scorer = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, scorer).collect()}
    assert len(got) == docs.count()
    for key, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(got[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    high = np.mean([s >= 0.7 for s, t in held if t == 1])
    false = np.mean([s >= 0.7 for s, t in held if t == 0])
    assert high >= 0.65 and false <= 0.05, (high, false)


def test_hard_rows(spark):
    texts = [f"you are a {w} person and nobody likes it {i}" if i % 2 else f"it is a fine day and the sun is out {i}" for i in range(80) for w in ("zorg",)]
    scorer = toxicity.fit(texts, np.array([i % 2 for i in range(80)]))
    rows = [(1, None), (2, ""), (2, ""), (None, "zorg"), (3, "fine " * 60000), (4, "plain words go on " * 300 + "you are a zorg person and nobody likes it " + "plain words go on " * 300), (5, "é 🙂 \x1c"), (6, "x" * 100000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, toxic int, score string").repartition(3)
    got = {r["doc_id"]: r for r in toxicity.score(docs, scorer).collect()}
    assert got[1]["score"] == got[2]["score"] == 0 and got[4]["score"] > 0.7 > got[3]["score"] and got[None]["held_out"] is False
    assert not toxicity.score(docs.limit(0), scorer).collect()
    none = toxicity.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_every_window_start_is_scored():
    texts = [f"you are a {w} person and nobody likes it {i}" if i % 2 else f"it is a fine day and the sun is out {i}" for i in range(80) for w in ("zorg",)]
    scorer = toxicity.fit(texts, np.array([i % 2 for i in range(80)]))
    # a cluster of scattered words of 30 words' length, wherever it stands among plain ones, and texts at a window's length
    rng = np.random.default_rng(1)
    vocabulary = "it is a fine day and the sun is out you are zorg person nobody likes".split()
    cluster = "zorg fine day and the sun nobody it is a likes fine day zorg and the sun is out it person is a fine zorg day and the nobody out".split()
    rows = ["fine " * shift + " ".join(cluster) + " fine" * (100 - shift) for shift in range(32, 62)]
    rows += [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 31, 32, 33, 34, 200, 2500)] + [""]
    got = scorer.scores([r.encode() for r in rows])
    want = []
    for r in rows:
        words = [toxicity.plain(w) for w in r.encode().split()]
        if words:
            gates = scorer.network.projected(scorer.network.inputs(*toxicity._numbers(words)))
            logits = one_by_one(scorer.network, gates, np.arange(len(words)), toxicity.LENGTH)[: max(1, len(words) - toxicity.LENGTH + 1)]
        want.append(max((1 / (1 + np.exp(-z)) for z in logits), default=0.0) if words else 0.0)
    assert np.allclose(got, want, atol=1e-4), np.abs(got - want).max()
    assert np.ptp(got[:30]) < 1e-3


def test_a_window_alone_has_the_score_it_has_in_its_text():
    """Windows are scored as trained: alone with CONTEXT words around them, in parts of a text, or in the whole text, the logit is the same."""
    import pyarrow.parquet as pq

    docs, labels = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels if r["toxic"] is not None}
    some = [(r["text"] or "", toxic[r["doc_id"]]) for r in docs if r["doc_id"] in toxic]
    net = toxicity.fit([t for t, _ in some], np.array([y for _, y in some]), 4).network
    words = [[toxicity.plain(w) for w in t.encode().split()] for t, _ in some]
    words = [w for w in words if len(w) > 300][:12] + [sum(words, [])[:5000]]
    names = sorted({x for w in words for x in w})
    place = {w: n for n, w in enumerate(names)}
    gates = net.projected(net.inputs(*toxicity._numbers(names)))
    counts = np.array([len(w) for w in words])
    at = np.array([place[x] for w in words for x in w])
    whole = net.every(gates, at, counts, toxicity.LENGTH, part=1 << 30)
    text, start = toxicity.spread(counts, 7)
    rows, real, pool = toxicity._windows(text, start, counts, at)
    alone = net.run(gates, rows, real, pool)
    apart = np.abs(alone - whole[start])
    print("alone", apart.max(), apart.mean(), "in parts", np.abs(net.every(gates, at, counts, toxicity.LENGTH) - whole).max())
    assert apart.max() < 0.05 and apart.mean() < 0.001 and np.abs(net.every(gates, at, counts, toxicity.LENGTH) - whole).max() < 0.02
