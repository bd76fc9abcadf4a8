"""From calls to procedures: steps, slots, families, needs; each case one session."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions import fixed, shell
from tracemill.operators import merge, mining, sessions

EDITS = "array<struct<path: string, created: boolean, symbols: array<string>>>"
CALLS = f"session string, task int, seq int, at timestamp, action string, path string, ok boolean, changes int, confirmed boolean, command string, exit_code int, error string, edits {EDITS}, declared_by string, declared boolean, strongest boolean"
TASKS = "session string, task int, repo string, summary string, first_seq int, model string, commit string, main_command string, main_source string"
START = 1_700_000_000


def prompt(text):
    return ("prompt", text)


def run(command, code=0, error=None):
    return ("run", command, code, error)


def edit(path, *symbols):
    return ("edit", path, False, symbols)


def create(path):
    return ("edit", path, True, ())


def read(path):
    return ("read", path)


def tables(spark, logs, main=None, source=None):
    calls, tasks = [], []
    for name, log in logs.items():
        task = 0
        for seq, (kind, what, *more) in enumerate(log):
            at = datetime.datetime.fromtimestamp(START + seq)
            if kind == "prompt":
                task += 1
                tasks.append((name, task, "5f0c", what, seq, "m", None, main, source))
            elif kind == "run":
                is_main = main is not None and shell.check_words(what) == shell.check_words(main)
                calls.append((name, task, seq, at, "run", None, more[0] == 0, 0, False, what, more[0] or None, more[1], None, source if is_main else None, is_main, is_main))
            elif kind == "edit":
                calls.append((name, task, seq, at, "edit", what, True, 1, False, None, None, None, [(what, more[0], list(more[1]))], None, False, False))
            else:
                calls.append((name, task, seq, at, "read", what, True, 0, False, None, None, None, None, None, False, False))
    rows = sessions.analyzed_calls(spark.createDataFrame(calls, CALLS).repartition(3))
    return rows, spark.createDataFrame(tasks, TASKS)


def mined(spark, logs, **more):
    judged, procedures = mining.extractions(*tables(spark, logs, **more), ["session", "task"])
    return {(r["session"], r["task"]): r for r in judged.collect()}, {(r["session"], r["task"]): r for r in procedures.collect()}


def steps(p):
    return [(s["kind"], s["target"] or s["command"]) for s in p["steps"]]


def family(*targets, program="npm test"):
    return "f_" + hashlib.sha256("\n".join(["5f0c", *sorted(set(targets)), program]).encode()).hexdigest()[:12]


FIX = [prompt("Fix the total. It is off"), run("npm install"), read("src/cart.js"), edit("src/cart.js", "total"), edit("src/cart.js", "sum"), run("npm test")]
LOGS = {
    "plain": FIX,
    "failed": [*FIX[:-1], run("npm test", 1)],
    "unchecked": FIX[:-1],
    "idle": [prompt("Look around"), run("npm test")],
    "outside": [prompt("x"), edit("../other/a.js"), run("npm test")],
    "secret": [prompt("x"), run("./gen.sh [REDACTED:token]"), edit("a.js"), run("npm test")],
    "danger": [prompt("x"), run("./gen.sh && sudo make"), edit("a.js"), run("npm test")],
    "many": [prompt("x"), *[edit(f"src/{n}.js") for n in range(25)], run("npm test")],
    "migration": [prompt("Add a column"), create("migrations/001_users.sql"), edit("src/db.js"), run("npm test -- migrations/001_users.sql")],
    "migration2": [prompt("Add a table"), create("migrations/002_orders.sql"), edit("src/db.js"), run("npm test -- migrations/002_orders.sql")],
    "generated": [prompt("x"), run("./gen.sh users"), edit("db/20240101_users.sql"), run("npm test")],
    "opened": [prompt("x"), run("cat db/20240101_users.sql"), run("./gen.sh users"), edit("db/20240101_users.sql"), run("npm test")],
    "named": [prompt("x"), run("./gen.sh ./db/20240101_users.sql"), edit("db/20240101_users.sql"), run("npm test")],
    "folder": [prompt("x"), run("./gen.sh users"), edit("prisma/migrations/20240101_users/migration.sql"), run("npm test")],
    "earlier": [prompt("Make it"), create("tools/report.py"), prompt("Add a flag"), edit("tools/report.py"), run("npm test")],
    "several": [prompt("x"), create("handlers/a.js"), create("handlers/b.js"), create("src/c.js"), create(".env"), run("./gen.sh handlers/a.js xhandlers/a.js ./handlers/a.js handlers/a.jsx"), run("npm test")],
    "phases": [prompt("x"), edit("a.js", "f"), run("./gen.sh"), run("./gen.sh"), edit("a.js", "g"), edit("b.js"), edit("a.js", "h"), run("npm test")],
    "errors": [prompt("x"), run("npm test", 1, "e1"), run("nope", 127, "e0"), run("npm test", 1, "e1"), run("npm run lint", 1, "e2"), edit("a.js"), run("npm run lint", 1, "late"), run("npm run lint"), run("npm test")],
    "needs": [prompt("x"), edit("a.js"), create("scripts/check.sh"), run("cd web && ../scripts/check.sh test && npx jest"), run("cd web && ./gradlew test")],
    "made": [prompt("x"), create("scripts/test.sh"), run("./scripts/test.sh")],
    "runner": [prompt("x"), edit("a.js"), run("timeout 60 npx jest")],
    "home": [prompt("x"), edit("a.js"), run("cd ~/x && ./test.sh")],
}


@pytest.fixture(scope="module")
def found(spark):
    return mined(spark, LOGS)


def test_why_tasks_become_no_procedures(found):
    why = {k[0]: r["why"] for k, r in found[0].items() if k[1] == 1}
    want = {"plain": None, "failed": "verification failed", "unchecked": "not verified", "idle": "no edits", "outside": "outside project", "secret": "secret", "many": "too many steps", "migration": None, "earlier": "not verified"}
    assert {k: why[k] for k in want} == want
    assert why["danger"] == "privilege escalation"
    assert {k for k, r in found[0].items() if r["why"] is None} == set(found[1])
    assert (found[0]["plain", 1]["tool_calls"], found[0]["failed", 1]["outcome"], found[0]["idle", 1]["outcome"]) == (5, "failed", "unjudged")


def test_a_plain_procedure(found):
    p = found[1]["plain", 1]
    assert steps(p) == [("setup", "npm install"), ("edit", "src/cart.js"), ("verify", "npm test")]
    assert p["steps"][1]["symbols"] == ["total", "sum"]
    assert (p["title"], p["text"], p["kind"], p["model"], p["first_seq"]) == ("Fix the total", "Fix the total. It is off", "fix", "m", 0)
    assert [tuple(e) for e in p["entities"]] == [("path", "src/cart.js"), ("symbol", "total"), ("symbol", "sum"), ("command", "npm test")]
    assert [tuple(c) for c in p["preconditions"]] == [("file", "src/cart.js"), ("program", "npm")]
    assert (p["family"], p["id"][2:], p["slots"], tuple(p["verify"])) == (family("src/cart.js"), p["family"][2:], [], ("npm test", None))


def test_new_files_become_slots_shared_by_a_family(found):
    a, b = found[1]["migration", 1], found[1]["migration2", 1]
    assert steps(a) == [("create", "migrations/{migration}.sql"), ("edit", "src/db.js"), ("verify", "npm test -- migrations/{migration}.sql")]
    assert a["family"] == b["family"] == family("migrations/{migration}.sql", "src/db.js")
    assert [tuple(s) for s in a["slots"]] == [("migration", "identifier", ["001_users"])]
    assert a["verify"]["command"] == "npm test -- migrations/{migration}.sql"
    # entities keep the file itself, and what must be there is its directory
    assert ("path", "migrations/001_users.sql") in [tuple(e) for e in a["entities"]]
    assert [tuple(c) for c in a["preconditions"]][:2] == [("file", "migrations"), ("file", "src/db.js")]


def test_generated_names_count_as_new_after_a_run(found):
    assert steps(found[1]["generated", 1])[1] == ("edit", "db/{db}.sql")
    for name in ("opened", "named"):  # touched before the run, or by it
        assert ("edit", "db/20240101_users.sql") in steps(found[1][name, 1])
    assert steps(found[1]["folder", 1])[1] == ("edit", "prisma/migrations/{migration}/migration.sql")
    assert [tuple(c) for c in found[1]["folder", 1]["preconditions"]][0] == ("file", "prisma/migrations")


def test_files_made_earlier_in_a_session_stay_new(found):
    assert steps(found[1]["earlier", 2]) == [("edit", "tools/{tool}.py"), ("verify", "npm test")]


def test_slots_are_numbered_and_replace_whole_paths(found):
    p = found[1]["several", 1]
    assert [s["target"] for s in p["steps"] if s["target"]] == ["handlers/{handler}.js", "handlers/{handler_2}.js", "src/{file}.js", ".env"]
    assert p["steps"][4]["command"] == "./gen.sh handlers/{handler}.js xhandlers/a.js ./handlers/{handler}.js handlers/a.jsx"
    assert [(s["name"], s["examples"]) for s in p["slots"]] == [("handler", ["a"]), ("handler_2", ["b"]), ("file", ["c"])]


def test_phases_and_errors(found):
    p = found[1]["phases", 1]
    assert steps(p) == [("edit", "a.js"), ("run", "./gen.sh"), ("edit", "a.js"), ("edit", "b.js"), ("verify", "npm test")]
    assert [s["symbols"] for s in p["steps"]] == [["f"], [], ["g", "h"], [], []]
    assert [e["value"] for e in found[1]["errors", 1]["entities"] if e["kind"] == "error"] == ["e1", "e2"]
    assert found[1]["errors", 1]["avoid"] == []


def test_what_a_check_needs(found):
    needs = lambda name: [tuple(c) for c in found[1][name, 1]["preconditions"]]
    assert needs("needs") == [("file", "a.js"), ("file", "scripts"), ("file", "web/gradlew")]
    assert found[1]["needs", 1]["steps"][-1]["command"] == "cd web && ./gradlew test"
    assert needs("made") == [("file", "scripts")]
    assert needs("runner") == [("file", "a.js"), ("program", "timeout"), ("program", "npx")]
    assert needs("home") == [("file", "a.js")]


def test_paths_located_from_where_a_command_starts():
    for command, path, want in [("./a", "./a", "a"), ("cd x && ./a", "./a", "x/a"), ("cd x; cd y\n./a", "./a", "x/y/a"), ("cd .. && t/a", "t/a", "../t/a"), ("cd /o && ./a", "./a", None), ("cd - && ./a", "./a", None), ("cd && ./a", "./a", None), ("~/a", "~/a", None)]:
        assert shell.located(command, path) == want, command


def test_the_strongest_declared_check_verifies(spark):
    logs = {"other": [prompt("x"), edit("a.js"), run("npm test")], "same": [prompt("x"), edit("a.js"), run("npm test"), run("make  all")]}
    _, got = mined(spark, logs, main="make all", source="Makefile")
    assert tuple(got["other", 1]["verify"]) == ("make all", "Makefile")
    assert [c["value"] for c in got["other", 1]["preconditions"]] == ["a.js", "npm", "make"]
    assert got["other", 1]["family"] == family("a.js")
    assert tuple(got["same", 1]["verify"]) == ("make  all", "Makefile")


def test_from_a_log_to_revisions(spark):
    """Two sessions of one kind of task leave one revision, made general."""
    rows, tasks = tables(spark, {k: LOGS[k] for k in ("migration", "migration2", "plain")})
    _, procedures = mining.extractions(rows, tasks, ["session", "task"])
    done = merge.upserted(mining.candidates(procedures, "session")).collect()
    assert sorted((r["revision"], r["sessions"]) for r in done) == [(1, 1), (1, 2)]


def plain_slot(path, taken):
    """A slot by the rules in turn, in plain Python."""
    generated = re.compile(fixed.GENERATED_NAME)
    folder, _, name = path.rpartition("/")
    outer, _, parent = folder.rpartition("/")
    stable = outer if generated.search(parent) and not generated.search(name) else folder
    inner = path[len(stable) :].lstrip("/")
    if "/" in inner:
        value, rest = inner.split("/", 1)
        rest = "/" + rest
    elif "." in inner:
        value, rest = inner.split(".", 1)
        rest = "." + rest
    else:
        value, rest = inner, ""
    if not value:
        return None
    last = stable.rsplit("/", 1)[-1]
    base = "file" if last in fixed.GENERIC_DIRS else re.sub("[^a-z0-9]", "_", "".join(c.lower() if c.isascii() else c for c in (last[:-1] if last.endswith("s") and len(last.encode()) > 3 else last)), flags=re.S)
    name, n = base, 2
    while name in taken:
        name, n = f"{base}_{n}", n + 1
    return name, value, (f"{stable}/" if stable else "") + f"{{{name}}}{rest}"


def test_slots_equal_plain_python(spark):
    rng = random.Random(9)
    parts = ["src", "users", "as", "Über-Dinge", "20240101_x", "V1__init", "deadbeef01_y", "file_2s", "file", "a.b", ".env", "x", "001.sql", "index.d.ts", "lib"]
    lists = [list(dict.fromkeys("/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6)))) for _ in range(300)]
    lists.append(["/abs/x.js", "a//b.js", "file_2/a", "src/b.js", "lib/c.js"])
    df = spark.createDataFrame([(n, p) for n, p in enumerate(lists)], "n int, p array<string>").select("n", mining.slots(F.col("p")).alias("s"))
    for r in df.collect():
        taken, want = [], []
        for path in lists[r["n"]]:
            if slot := plain_slot(path, taken):
                taken.append(slot[0])
                want.append((path, *slot))
        assert [tuple(s) for s in r["s"]] == want


def test_substitution_equals_plain_python(spark):
    def plain(command, path, template):
        part = lambda c: c.isalnum() or c in "_-./"
        out, at = "", 0
        while (i := command.find(path, at)) >= 0:
            before = command[:i].removesuffix("./")
            whole = not (before and part(before[-1])) and not (command[i + len(path) : i + len(path) + 1] and part(command[i + len(path)]))
            out += command[at:i] + (template if whole else path)
            at = i + len(path)
        return out + command[at:]

    rng = random.Random(4)
    some = ["a/b.js", "./", " ", "x", "'", "é", "-", "/", ".", "$1", "\\", "\\E"]
    rows = [("".join(rng.choice(some) for _ in range(rng.randint(1, 8))), rng.choice(["a/b.js", "x", "\\E", "a/b.js'x"]), rng.choice(["{f}.js", "$1\\{g}"])) for _ in range(500)]
    df = spark.createDataFrame(rows, "c string, p string, t string")
    for r in df.select("*", mining.substituted(F.col("c"), F.col("p"), F.col("t")).alias("s")).collect():
        assert r["s"] == plain(r["c"], r["p"], r["t"]), r
