"""Tasks, steps, lessons and the upsert fold, each against plain Python or a table of answers."""

import random

from pyspark.sql import functions as F

from tracemill.functions import shell
from tracemill.operators import merge, sessions

CALLS = "task int, seq int, action string, ok boolean, changes int, confirmed boolean, command string, exit_code int, declared boolean, strongest boolean"


def calls_of(spark, tasks):
    """tasks: lists of (what, ok) or (what, ok, exit_code); 'edit' is an edit."""
    rows = []
    for n, calls in enumerate(tasks):
        for seq, (what, ok, *code) in enumerate(calls):
            edit = what == "edit"
            rows.append((n, seq, "edit" if edit else "run", ok, int(edit), False, None if edit else what, code[0] if code else None, what == "make all", what == "make all"))
    return sessions.analyzed_calls(spark.createDataFrame(rows, CALLS).repartition(3))


def judged(calls):
    """outcome and reason of one task, by rules in turn."""
    seen = lambda c: shell.analyzed(c) if c != "edit" else None
    edits = [i for i, (c, ok, *_) in enumerate(calls) if c == "edit" and ok]
    if not edits:
        return "unjudged", "no edits"
    e = edits[-1]
    learned = {c for i, (c, ok, *_) in enumerate(calls) if i <= e and not ok and c != "edit" and seen(c)[14] and any(o and d == c for d, o, *_ in calls[e + 1 :])}
    check = lambda c: c != "edit" and (seen(c)[5] or c in learned or c == "make all")
    after = [(c, ok) for c, ok, *_ in calls[e + 1 :] if check(c)]
    visible = [(c, ok) for c, ok in after if not (ok and seen(c)[9])]
    if not visible:
        return ("unjudged", "status hidden") if after else ("failed", "not verified")
    covers = lambda p, f: seen(p)[6] if seen(f)[6] else seen(p)[8] == seen(f)[8]
    open_ = any(not ok and not any(o and covers(p, c) for p, o in visible[i + 1 :]) for i, (c, ok) in enumerate(visible))
    main = [ok for c, ok in after if c == "make all"]
    return ("failed", "verification failed") if not visible[-1][1] or open_ or (main and not main[-1]) else ("succeeded", None)


def test_outcomes(spark):
    rng = random.Random(3)
    some = ["edit", "edit", "pytest -q", "pytest -q | tail", "cargo clippy", "cargo check", "make all", "./gen.sh", "ls", "npm run lint; echo x"]
    tasks = [[(rng.choice(some), rng.random() < 0.6) for _ in range(rng.randint(1, 9))] for _ in range(250)]
    got = {r["task"]: (r["outcome"], r["why"]) for r in sessions.judged(calls_of(spark, tasks), ["task"]).collect()}
    assert got == {n: judged(t) for n, t in enumerate(tasks)}
    assert len(set(got.values())) == 5


def lessons(calls):
    out = []
    for i, (c, ok, *code) in enumerate(calls):
        later = calls[i + 1 :]
        if ok or c == "edit" or any(o and d == c for d, o, *_ in later):
            continue
        missing = bool(code) and code[0] == 127
        a = shell.analyzed(c)
        for d, o, *_ in later:
            if d == "edit":
                if o and not missing:
                    break
                continue
            b = shell.analyzed(d)
            fits = a[17] is not None and a[17] == b[17] if missing else a[5] and b[5] and (b[6] if a[6] else a[8] == b[8])
            if o and not b[9] and d != c and fits:
                out.append(f"`{c}` failed{f' (exit {code[0]})' if code and code[0] is not None else ''}; `{d}` worked")
                break
        if len(out) == 3:
            break
    return out


def test_avoid_lines(spark):
    rng = random.Random(5)
    some = ["edit", "pytest -q", "pytest", "python -m pytest", "cargo clippy", "cargo clippy --all", "tox", "venv/bin/pytest -q", "ls"]
    tasks = [[(rng.choice(some), rng.random() < 0.4, rng.choice([None, 1, 127])) for _ in range(rng.randint(2, 10))] for _ in range(250)]
    tasks = [[(c, ok, None if ok else code) for c, ok, code in t] for t in tasks]
    got = {}
    for r in sessions.avoid_lines(calls_of(spark, tasks), ["task"]).orderBy("task", "seq").collect():
        got.setdefault(r["task"], []).append(r["line"])
    assert got == {n: x for n, t in enumerate(tasks) if (x := lessons(t))}


def test_steps(spark):
    edits = lambda *paths: [(p, False, [p[0]]) for p in paths]
    rows = [(0, "run", True, None, "npm ci"), (1, "edit", True, edits("a.py", "b.py"), None), (2, "edit", True, [("a.py", False, ["x"])], None), (3, "run", True, None, "./gen.sh"), (4, "run", True, None, "./gen.sh"), (5, "edit", True, edits("a.py"), None), (6, "run", True, None, "./gen.sh"), (7, "run", True, None, "npm ci"), (8, "run", True, None, "pytest"), (9, "edit", True, edits("c.py"), None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "task int, seq int, action string, ok boolean, edits array<struct<path: string, created: boolean, symbols: array<string>>>, command string")
    df = sessions.analyzed_calls(df.withColumn("changes", F.coalesce(F.size("edits"), F.lit(0))).withColumn("confirmed", F.lit(False)).withColumn("verified_at", F.lit(8)))
    steps = sessions.work_steps(df, ["task"])
    got = [(r["kind"], r["target"] or r["command"], r["symbols"]) for r in steps.orderBy("seq", "at").collect()]
    assert got == [("edit", "a.py", ["a", "x"]), ("edit", "b.py", ["b"]), ("run", "./gen.sh", []), ("edit", "a.py", ["a"]), ("run", "./gen.sh", [])]
    assert [(r["seq"], r["command"]) for r in sessions.setup_steps(df, ["task"]).collect()] == [(0, "npm ci")]
    bad = steps.withColumn("target", F.when(F.col("target") == "b.py", "../b.py").otherwise(F.col("target")))
    assert not sessions.refused_steps(steps, ["task"]).collect() and sessions.refused_steps(bad, ["task"]).first()["why"] == "outside project"


def test_nearest_keeps_repeated_rows(spark):
    left = spark.createDataFrame([("s", 100)] * 3 + [("s", 900)], "s string, t int").withColumn("at", F.timestamp_seconds("t")).select("s", "at")
    right = spark.createDataFrame([("s", 90, 1), ("s", 110, 2)], "s string, t int, seq int").withColumn("at", F.timestamp_seconds("t")).select("s", "at", "seq")
    got = sessions.nearest(left, right, "s", "at", "at", "seq", 120).collect()
    assert [r["near_seq"] for r in got] == [1, 1, 1]


CANDIDATES = "family string, at timestamp, session string, first_seq long, kind string, text string, steps array<struct<kind: string, target: string, command: string>>, verify string, slots array<struct<name: string, kind: string, examples: array<string>>>, avoid array<string>"


def candidate(spark, n, family, command, kind=None, text="t", session=None, target="a.py"):
    return (family, n, session or f"s{n}", 0, kind, text, [("edit", target, None), ("run", None, command)], command, [], [f"lesson {n}"])


def test_upserts(spark):
    given = [
        candidate(spark, 1, "f", "pytest tests/a.py"), candidate(spark, 2, "f", "pytest tests/a.py", text="again"), candidate(spark, 3, "f", "pytest tests/b.py"), candidate(spark, 4, "f", "pytest tests/c.py", session="s1"),
        candidate(spark, 5, "f", "cargo test", target="b.py"), candidate(spark, 6, "g", "make x", kind="fix"), candidate(spark, 7, "g", "make x", kind="add"), candidate(spark, 8, "g", "make y", kind="add"),
    ]
    df = spark.createDataFrame([(f, None, *r) for f, _, *r in given], CANDIDATES).withColumn("at", F.timestamp_seconds(F.substring("session", 2, 9).cast("int"))).repartition(3)
    df = df.withColumn("at", F.when((F.col("session") == "s1") & F.col("verify").contains("c.py"), F.timestamp_seconds(F.lit(4))).otherwise(F.col("at")))
    got = {(r["session"], r["upsert"], r["revision"]) for r in merge.upserted(df, "upserts").collect()}
    assert got == {("s1", "created", 1), ("s2", "refreshed", 1), ("s3", "generalized", 1), ("s1", "generalized", 1), ("s5", "revised", 2), ("s6", "created", 1), ("s7", "created", 1), ("s8", "generalized", 1)}
    rows = {(r["family"], r["revision"]): r for r in merge.upserted(df).collect()}
    f = rows["f", 1]
    assert f["verify"] == "pytest {test}" and f["sessions"] == 3 and f["prompts"] == ["again"] and f["avoid"] == ["lesson 1", "lesson 2", "lesson 3"]
    assert '"test": {"kind": "path", "examples": ["tests/a.py", "tests/b.py", "tests/c.py"]}' in f["slots"] and rows["f", 2]["state"] == "candidate"
    assert len(rows) == 4 and {k[0] for k in rows} - {"f", "g"} == {"f_" + merge.hashlib.sha256(b"g\nadd").hexdigest()[:12]}


def test_states_after_a_refresh():
    def family(*states):
        f = merge.Family()
        f.revisions = [{"family": "f", "steps": [["run", None, c]], "verify": None, "slots": {}, "text": "t", "kinds": [None], "prompts": [], "avoid": [], "sessions": [], "revision": n + 1, "state": s, "signature": merge.step_signature([["run", None, c]]), "created_at": 0, "updated_at": 0} for n, (s, c) in enumerate(states)]
        return f

    new = lambda c: {"family": "f", "steps": [["run", None, c]], "verify": None, "slots": {}, "text": "t", "kind": None, "avoid": [], "session": "s", "at": 1}
    cases = [([("stale", "a")], "a", "active"), ([("archived", "a")], "a", "active"), ([("archived", "a"), ("active", "b c")], "a", "candidate"), ([("retired", "a")], "x y", "retired"), ([("archived", "a")], "x y", "active"), ([("quarantined", "a")], "a", "quarantined"), ([("active", "a")], "x y", "candidate")]
    for states, command, want in cases:
        assert family(*states).upsert(new(command))[0]["state"] == want, (states, command)
