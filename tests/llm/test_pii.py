import hashlib
import random
import re

import numpy as np

from tracemill.llm import pii

SF = "/root/testdata/sf0.01"


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((*m.span(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    for alphabet in ("0123.+- ()", "ab@.-_ 1", "0001.25@+a- "):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(text) == brute(text), text
    for text in ("1" * 5000, "a" * 5000 + "@", "1." * 3000, "+1" + "(" * 5000, "4111 1111 1111 1111 4111-1111-1111-1111", "x@y.zé+49 30 1234567"):
        assert pii.base_spans(text) == brute(text)


def check(docs):
    got = {}
    for r in pii.find_personal_data(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for key, text in ((r["doc_id"], r["text"]) for r in docs.collect()):
        base = brute(text)
        digest = hashlib.sha256(pii.joined(base).encode()).hexdigest()
        row = next(r for r in got[key] if r["base_sha256"] == digest)
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert set(filter(None, pii.joined(base).split(","))) <= set(row["spans"].split(","))
    return got


def test_documents(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    base = sum(r[f"n_{k}"] for rows in got.values() for r in rows for k in pii.KINDS)
    every = sum(len(list(filter(None, r["spans"].split(",")))) for rows in got.values() for r in rows)
    assert base > 20 and every - base < 0.2 * base


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "mail a@b.co"), (3, "é 🙂 1.2.3.4 +49 30 1234567"), (4, "word " * 50000 + "a@b.co " + "x@" * 1000), (5, "call 0171 2345678 or mail jane dot doe at example dot com")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n_ip int").repartition(3)
    got = check(docs)
    assert "phone:" in got[5][0]["spans"] and got[5][0]["n_phone"] == 0
    assert not pii.find_personal_data(docs.limit(0)).collect()


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    field = pii.ChainField(("a", "b", "c"), 64)
    field.weights, field.moves = rng.standard_normal((64, 3)), rng.standard_normal((3, 3))
    sequences = [[(f"{rng.integers(99)}",) for _ in range(n)] for n in (1, 5, 3, 6)]
    import itertools

    for s, got in zip(sequences, field.decode(sequences), strict=True):
        score = lambda p, s=s: sum(field.weights[field.at(f)[0], y] for f, y in zip(s, p, strict=True)) + sum(field.moves[a, b] for a, b in itertools.pairwise(p))
        assert tuple(got) == max(itertools.product(range(3), repeat=len(s)), key=score)


def test_stretches_give_the_labels_of_whole_texts():
    rng = random.Random(6)
    some = ["call", "0171", "2345678", "jane", "dot", "doe", "at", "example", "com", "plain", "words", "Here", "go", "on", "12", "4111-1111", "page", "of", "tel", "(030)", "123-4567", "version", "1.2.3"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "plain " * 5000 + "call 0171 2345678 " + "words " * 5000]
    tagger, field = pii.Tagger(pii.trained()), pii.trained()
    found = [np.zeros(len(t.split()), int) for t in texts]
    for n, first, tags in tagger.tags(texts):
        found[n][first : first + len(tags)] = tags
    for t, got, want in zip(texts, found, field.decode([pii.features(t.split()) for t in texts]), strict=True):
        assert got.tolist() == want.tolist(), t


def test_added_spans_are_found_in_plain_text():
    """Spans of kinds that the patterns don't have, with digits and names of their own, among words of real documents."""
    import pyarrow.parquet as pq

    rng = random.Random(8)
    words = [w for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column("text").to_pylist() for w in (t or "").split() if w.isalpha()]
    number = lambda form: "".join(str(rng.randrange(1, 10)) if c == "#" else c for c in form)
    name = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    kinds = {"phone": lambda: "call " + number("#### #######"), "email": lambda: f"mail {name()} dot {name()} at {name()} dot com", "card": lambda: "card " + _luhn(rng), "ip": lambda: "host " + number("1## . 1# . # . 1##")}
    texts, want = [], []
    for i in range(800):
        a, b = (" ".join(rng.choice(words) for _ in range(30)) for _ in range(2))
        kind = ("phone", "email", "card", "ip", None)[i % 5]
        texts.append(f"{a} {kinds[kind]()} {b}" if kind else f"{a} {b}")
        want.append(kind)
    bases = [pii.base_spans(t) for t in texts]
    found = pii.added_spans(texts, bases, pii.Tagger(pii.trained()))
    right = sum(bool(k) and any(x[2] == k for x in [*f, *b]) for f, b, k in zip(found, bases, want, strict=True))
    wrong = sum(x[2] != k for f, k in zip(found, want, strict=True) for x in f)
    print("recall", right / sum(map(bool, want)), "wrong", wrong)
    assert right >= 0.9 * sum(map(bool, want)) and wrong <= 0.1 * right


def _luhn(rng):
    digits = [rng.randrange(10) for _ in range(15)]
    last = next(d for d in range(10) if pii.luhn("".join(map(str, [*digits, d]))))
    s = "".join(map(str, [*digits, last]))
    return f"{s[:4]}/{s[4:8]}/{s[8:12]}/{s[12:]}"


def test_shapes():
    want = {"word": "xx", "a": "x", "A": "X", "Ab": "Xx", "Word,": "Xxx,", "WORD": "XX", "wORD": "xXX", "Élan.": "Xxx.", "日本語": "xx", "a1b22": "x9x99", "12345678": "9999999", "it's": "xx'x", "x" * 70: "xx", "#" * 70 + "1": "#" * 70 + "9", "a.b": "x.x", "...": "..."}
    assert {w: pii.shape(w) for w in want} == want
