"""Operators that decide text by text (commands, secrets, errors, follow-ups, templates), over every line of documents.

A line picks a form by its place, and its own content fills the form: {w} and {v} are two names made of the line, {h} its digest.
SQL makes the same names and gives the answer of each form in terms of them. Commands are put together of three parts, answers too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import patches, redaction, shell, text
from tracemill.operators import checks, merge
from tracemill.plans.common import registrar, table

query, QUERIES, ORACLE = registrar()

# Names have no vowels, so that they are no words that a rule knows.
DIGITS, CONSONANTS = "0123456789abcdef", "bcdghjkmnpqvwxyz"
LINES = f"""l AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
  n AS (SELECT *, md5(said) AS h, 'k' || translate(substr(md5(said), 1, 7), '{DIGITS}', '{CONSONANTS}') AS w, 'k' || translate(substr(md5(said), 9, 7), '{DIGITS}', '{CONSONANTS}') AS v FROM l)"""


def _named(rows: DataFrame, content: Column) -> DataFrame:
    """rows with the digest h of their content and two names w, v made of it."""
    name = lambda at: F.concat(F.lit("k"), F.translate(F.substring("h", at, 7), DIGITS, CONSONANTS))
    return rows.withColumn("h", F.md5(content)).withColumns({"w": name(1), "v": name(9)})


def _lines(spark, d) -> DataFrame:
    """(doc_id, line, said, h, w, v): every line of every text with its names."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "said"))
    return _named(rows.withColumn("line", F.col("line").cast("bigint")), F.col("said"))


def _filled(form: Column) -> Column:
    for name in ("w", "v", "h"):
        form = F.replace(form, F.lit("{" + name + "}"), F.col(name))
    return form


def _picked(cases: list[tuple], at: int, by: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c[at]).cast("string") for c in cases)), (by % len(cases) + 1).cast("int"))


def _given(spark, d, cases: list[tuple], *names: str) -> DataFrame:
    """doc_id, line and the first columns of the case that the line's place picks, filled with its names."""
    place = F.col("doc_id") + F.col("line")
    return _lines(spark, d).select("doc_id", "line", *(_filled(_picked(cases, n, place)).alias(name) for n, name in enumerate(names)))


def _sql(x) -> str:
    if not isinstance(x, str):
        return "NULL" if x is None else str(x).lower()
    return "'" + x.replace("'", "''") + "'"


def _rows(cases: list[tuple], skip: int) -> str:
    return ", ".join("(" + ", ".join([str(n), *map(_sql, c[skip:])]) + ")" for n, c in enumerate(cases))


def _answers(cases: list[tuple], skip: int, *names: str) -> str:
    is_text = [any(isinstance(c[skip + n], str) for c in cases) for n in range(len(names))]
    out = ", ".join(f"replace(replace(replace({x}, '{{w}}', w), '{{v}}', v), '{{h}}', h) AS {x}" if t else x for x, t in zip(names, is_text, strict=True))
    return f"WITH {LINES} SELECT doc_id, line, {out} FROM n JOIN (VALUES {_rows(cases, skip)}) c(i, {', '.join(names)}) ON (doc_id + line) % {len(cases)} = i"


# before a command, the programs that it starts
BEFORE = [("", ""), ("cd {v} && ", ""), ("RUST_LOG={v} ", ""), ("sudo -u root ", "sudo,"), ("env A={v} timeout 30 ", "env,timeout,"), ("cd {v}; ", "")]
# after it, whether that hides its status
AFTER = [("", False), (" 2>&1", False), (" | tail -5", True), ("; echo {v}", True), (" || true", True), (" 2>&1 | head -n 20", True), (" | tail -5 || true", True)]
# command, program, action, is_check, runs_tests, executables
COMMANDS = [
    ("cargo test -p {w}", "cargo test", "run", True, True, "cargo"), ("cargo --locked build", "cargo build", "run", True, False, "cargo"), ("npx jest -q", "jest", "run", True, True, "npx"),
    ("make {w}", "make {w}", "run", False, False, "make"), ("make -j 8 -C {w} check", "make check", "run", True, False, "make"), ("./gradlew :{w}:check", "gradle :{w}:check", "run", True, False, "./gradlew"),
    ("pytest --collect-only", "pytest", "run", False, True, "pytest"), ("pytest {w}.py", "pytest", "run", True, True, "pytest"), ("python3 tools/check.py {w}", "python tools/check.py", "run", True, False, "python3"),
    ("grep -rn '{w} | {v}' src", "grep", "search", False, False, "grep"), ("sed -n 1,20p {w}.md", "sed", "read", False, False, "sed"), ("sed -i s/{w}/{v}/ notes.md", "sed", "run", False, False, "sed"),
    ("git -C {w} grep {v}", "git grep", "search", False, False, "git"), ("npm run lint", "npm run", "run", True, False, "npm"), ("go vet ./{w}/...", "go vet", "run", True, False, "go"),
    ("uv run mypy {w}", "mypy", "run", True, False, "uv"), ("node --test {w}", "node", "run", True, True, "node"), ("./{w}.sh tests", "{w}.sh", "run", True, True, "./{w}.sh"),
    ("echo 'cargo test && {w}'", "echo", "run", False, True, "echo"), ("tox", "tox", "run", True, True, "tox"), ("git status {w}", "git status", "run", False, False, "git"),
]


# an echo behind a semicolon counts as a trailing filter, also as the whole command (gone)
@query(f"""WITH {LINES}, parts AS (SELECT * FROM n JOIN (VALUES {_rows(BEFORE, 0)}) b(i, before, starts) ON line % {len(BEFORE)} = b.i JOIN (VALUES {_rows(COMMANDS, 0)}) c(i, command, program, action, is_check, runs_tests, started) ON (doc_id + line) % {len(COMMANDS)} = c.i
  JOIN (VALUES {_rows(AFTER, 0)}) a(i, after, hides) ON length(said) % {len(AFTER)} = a.i)
  SELECT doc_id, line, replace(program, '{{w}}', w) AS program, action, is_check, runs_tests AND NOT gone AS runs_tests, hides AS hides_status, CASE WHEN gone THEN 'cd ' || v ELSE replace(replace(before || command, '{{w}}', w), '{{v}}', v) END AS clean, replace(starts || started, '{{w}}', w) AS executables FROM (SELECT *, before = 'cd {{v}}; ' AND command LIKE 'echo%' AS gone FROM parts)""")
def q53_commands(spark, d):
    place = F.col("doc_id") + F.col("line")
    parts = [_picked(BEFORE, 0, F.col("line")), _picked(COMMANDS, 0, place), _picked(AFTER, 0, F.length("said"))]
    rows = _lines(spark, d).select("doc_id", "line", shell.analysis(_filled(F.concat(*parts))).alias("c"))
    return rows.select("doc_id", "line", "c.program", "c.action", "c.is_check", "c.runs_tests", "c.hides_status", "c.clean", F.array_join("c.executables", ",").alias("executables"))


# passed, failed, whether the pass answers the failure
COVERED = [("pytest -q", "cargo test", True), ("cargo clippy", "cargo clippy --all | tail", True), ("cargo check", "cargo clippy", False), ("make lint", "npm test", False), ("npm run lint", "npm run types", True), ("go test ./...", "go vet", False)]


@query(_answers(COVERED, 2, "covers"))
def q54_covers(spark, d):
    rows = _given(spark, d, COVERED, "passed", "failed")
    rows = rows.withColumn("p", shell.analysis(F.col("passed"))).withColumn("f", shell.analysis(F.col("failed")))
    return rows.select("doc_id", "line", shell.covers(F.col("p"), F.col("f")).alias("covers"))


SECRETS = [
    ("set X-Api-Key: {h} now", "set X-Api-Key: [REDACTED:assignment] now"), ('{"password":"{w}","user":"{v}"}', '{"password":[REDACTED:assignment],"user":"{v}"}'),
    ("curl -u {v}:{w} https://h.example", "curl -u {v}:[REDACTED:cli-password] https://h.example"), ("mysql -u {v} -p{w} shop", "mysql -u {v} -p[REDACTED:cli-password] shop"),
    ("sshpass -p {w} ssh a@b", "sshpass -p [REDACTED:cli-password] ssh a@b"), ("run --client-secret {w} --verbose {v}", "run --client-secret [REDACTED:flag] --verbose {v}"),
    ("export MAIL_KEY={h} {w}", "export MAIL_KEY=[REDACTED:hex-secret] {w}"), ("write {w}@{v}.org soon", "write [REDACTED:email] soon"),
    ("Set-Cookie: {w}={v}; Path=/", "Set-Cookie: [REDACTED:cookie]"), ("TOKEN_TYPE={v},password={w}", "TOKEN_TYPE=[REDACTED:assignment]"), ("git clone git@git.example.org:{w}/{v}.git", "git clone git@git.example.org:{w}/{v}.git"),
    ("MAX_TOKENS=4096 ./{w}", "MAX_TOKENS=4096 ./{w}"), ("PASSWORD_FILE=/run/{v}/{w} ./run", "PASSWORD_FILE=/run/{v}/{w} ./run"), ("TOKEN=$TOKEN ./{w}", "TOKEN=$TOKEN ./{w}"),
    ("pull {w}@sha256:{h}{h}", "pull {w}@sha256:{h}{h}"), ("--no-password {w}", "--no-password {w}"), ("assert token == {w}_{v}", "assert token == {w}_{v}"),
    ("cd /home/eve/{w} && ls /home/eve{v}", "cd ~/{w} && ls /home/eve{v}"), ("DB_PASSWORD={w} ./{v}", "DB_PASSWORD=[REDACTED:assignment] ./{v}"), ("DEBUG_SECRETS=0 ./{w}", "DEBUG_SECRETS=0 ./{w}"), ("see {w} and {v} at {h}", "see {w} and {v} at {h}"),
]


@query(_answers(SECRETS, 1, "redacted"))
def q55_redaction_cases(spark, d):
    return _given(spark, d, SECRETS, "said").select("doc_id", "line", text.redact(F.col("said"), "/home/eve").alias("redacted"))


ERRORS = [
    ("{v}\nTypeError: {w} is 5 at /srv/{w}/b.py\n", "typeerror: {w} is N at <path>"), ("Traceback (most recent call last)\nValueError: {v}\nKeyError: '{w}'", "keyerror: '{w}'"), ("sh: {w}: command not found", "sh: {w}: command not found"),
    ("src/{v}.rs:10:5: mismatched {w}", "mismatched {w}"), ("src/{w}.c:10: warning: unused", None), ("{v}.ts(3,4): error TS2304: no name '{w}'", "error ts2304: no name '{w}'"), ("all {w} fine", None),
    ("AssertionError: expected 1 to equal 2", None), ("Exception in thread \"{v}\" java.lang.{w}Exception", "java.lang.{w}exception"), ("npm ERR! code E404\nnpm ERR! {w} not found", "npm err! {w} not found"),
    ("error[E0308]: mismatched {w}\n  --> src/{v}.rs", "error[e0308]: mismatched {w}"), ("\x1b[31merror\x1b[0m: could not compile {w}", "error: could not compile {w}"), ("error: wrong password {w}!x", None), ("Exit code 1\nfatal: not a git repository {w}", "fatal: not a git repository {w}"),
    ("panic: index out of range [7] with {w} 3", "panic: index out of range [N] with {w} N"), ("error: token={h} refused", None), ("{w}\n{v}\nfatal: {w} is gone\n{h}", "fatal: {w} is gone"),
]


@query(_answers(ERRORS, 1, "signature"))
def q56_error_cases(spark, d):
    return _given(spark, d, ERRORS, "said").select("doc_id", "line", text.error_signature(F.col("said")).alias("signature"))


# prompt, goes on, is nothing but that
FOLLOW_UPS = [
    ("yes", True, True), ("ok, still failing", True, True), ("lgtm, thanks!", True, True), ("it still fails at {w}", True, False), ("Add a page for {w}", False, False), ("no, use {w} instead of {v}", True, False), ("go ahead", True, True),
    ("Now the tests fail with {w}", True, False), ("you forgot the {w}", True, False), ("why did you remove {w}?", True, False), ("Fix the crash in {w}", False, False), ("wrong file", True, True), ("retry", True, True),
    ("please add {w} to the client {v}", False, False), ("that didn’t help", True, True), ("same error", True, True), ("Same layout as {w}, but {v}", False, False), ("...", True, True), ("undo that", True, True), ("the build is still red", True, False),
]


@query(_answers(FOLLOW_UPS, 1, "follow_up", "bare"))
def q57_follow_up_cases(spark, d):
    return _given(spark, d, FOLLOW_UPS, "said").select("doc_id", "line", text.follow_up(F.col("said")).alias("follow_up"), text.bare_follow_up(F.col("said")).alias("bare"))


# command, output, verdict
VERDICTS = [
    ("cargo test {w} | tail -5", "{v}\ntest result: ok. 5 passed; 0 failed", "passed"), ("cargo test {w}", "test result: ok. 5 passed", None), ("pytest -q {w}; echo done", "{v}\n3 failed, 2 passed in 1s", "failed"), ("pytest {w} | tee {v}", "{h}\n5 passed in 1s", "passed"),
    ("ls {w} | wc", "FAILED {v}", None), ("cargo build | tail", "    Finished dev [unoptimized] target(s) in 3s\n{w}", "passed"), ("npm test | tail", "    Finished dev target(s)\n{w}", None), ("go test ./{w}/... | tail", "ok  \tshop/{w}\t0.3s", "passed"),
    ("npx tsc {w} | head", "{v}.ts(1,2): error TS2304: x", "failed"), ("make check & wait", "{w}\nAll checks passed!", "passed"), ("sh scripts/test.sh {w} || true", "--- FAIL: {w}", "failed"), ("pytest -q {w} 2>&1", "1 failed", None),
]


@query(_answers(VERDICTS, 2, "verdict"))
def q58_verdict_cases(spark, d):
    rows = _given(spark, d, VERDICTS, "command", "said").withColumn("c", shell.analysis(F.col("command")))
    return rows.select("doc_id", "line", text.verdict(F.col("c"), F.col("said")).alias("verdict"))


# two commands, their template (null: they stay apart)
TEMPLATES = [
    ("pytest tests/{w}.py -q", "pytest tests/{v}.py -q", "pytest {test} -q"), ("make {h} --port 80", "make {h} --port 81", "make {h} --port {port}"), ("tool --bin={w} {h}", "tool --bin={v} {h}", "tool --bin={bin} {h}"), ("ls -{w}", "ls -{v}", None),
    ("go a{w} b{w} c{w}", "go a{v} b{v} c{v}", None), ("cp {w}1 {w}2 {h}", "cp {v}1 {v}2 {h}", "cp {arg} {arg_2} {h}"), ("mv {w} {w}", "mv {v} {v}", "mv {arg} {arg}"), ("run {w}", "run {w} {v}", None), ("make {w}", "just {w}", None), ("npm test {w}", "npm test {w}", "npm test {w}"),
]


@query(f"""WITH n AS (SELECT doc_id, md5(text) AS h, 'k' || translate(substr(md5(text), 1, 7), '{DIGITS}', '{CONSONANTS}') AS w FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, replace(replace(template, '{{w}}', w), '{{h}}', h) AS template FROM n JOIN (VALUES {_rows(TEMPLATES, 2)}) c(i, template) ON doc_id % {len(TEMPLATES)} = i""")
def q52_anti_unify(spark, d):
    texts = _named(table(spark, d, "documents").where("text IS NOT NULL"), F.col("text"))
    rows = texts.select("doc_id", *(_filled(_picked(TEMPLATES, n, F.col("doc_id"))).alias(name) for n, name in enumerate(("one", "two"))))
    step = lambda c: F.array(F.struct(F.lit("run").alias("kind"), F.lit(None).cast("string").alias("target"), F.col(c).alias("command")))
    slots = F.array().cast("array<struct<name: string, kind: string, examples: array<string>>>")
    both = [rows.select(F.col("doc_id").cast("string").alias("family"), F.timestamp_seconds(F.lit(n)).alias("at"), F.lit(c).alias("session"), F.lit(0).cast("bigint").alias("first_seq"), F.lit(None).cast("string").alias("kind"), F.lit("same").alias("text"), step(c).alias("steps"), F.lit(None).cast("string").alias("verify"), slots.alias("slots"), F.array().cast("array<string>").alias("avoid")) for n, c in enumerate(("one", "two"))]
    found = merge.upserted(both[0].unionByName(both[1]))
    command = F.get_json_object("signature", "$[0][2]")
    return found.groupBy(F.col("family").cast("bigint").alias("doc_id")).agg(F.when(F.count("*") == 1, F.max(command)).alias("template"))


# patch or edit, path:created:added:removed:symbols of each file
PATCHES = [
    ("*** Begin Patch\n*** Add File: src/{w}.py\n+def {w}(x):\n+    return x\n*** Update File: {v}.rs\n@@ fn {v}\n-let a = 1;\n+let b = 2;\n+fn j{v}() {}\n*** End Patch", "src/{w}.py:true:2:0:{w} {v}.rs:false:2:1:j{v},{v}"),
    ("*** Begin Patch\n*** Update File: {v}.js\n*** Move to: {w}.js\n@@\n-const {w} = (a) => a\n+const z{w} = (a) => a\n*** Delete File: {v}.txt\n*** End Patch", "{w}.js:false:1:1:{w},z{w} {v}.txt:false:0:0:"),
    ("nothing of {w}", ""),
]


@query(_answers(PATCHES, 1, "files"))
def q59_patch_files(spark, d):
    def shown(f: Column) -> Column:
        diff = patches.patch_diff(f["body"])
        return F.concat_ws(":", f["path"], f["created"].cast("string"), diff["added"].cast("string"), diff["removed"].cast("string"), F.array_join(text.symbols(diff["changed"]), ","))

    return _given(spark, d, PATCHES, "patch").select("doc_id", "line", F.array_join(F.transform(patches.patched_files(F.col("patch")), shown), " ").alias("files"))


@query(f"""WITH r AS (SELECT 'r' || source AS repo, md5(min(text)) AS h FROM documents GROUP BY source), n AS (SELECT *, 'k' || translate(substr(h, 1, 7), '{DIGITS}', '{CONSONANTS}') AS w, 'k' || translate(substr(h, 9, 7), '{DIGITS}', '{CONSONANTS}') AS v FROM r)
  SELECT repo, n, replace(command, '{{w}}', w) AS command, source, strength FROM n AS x CROSS JOIN (VALUES (1, 'make check', 'Makefile', 2), (2, 'pytest -q {{w}}', 'AGENTS.md', 1), (3, 'pnpm test', 'package.json', 1), (4, 'make test', 'Makefile', 1), (5, 'cargo test', 'Cargo.toml', 1)) c(n, command, source, strength)""")
def q89_declared_checks(spark, d):
    repos = table(spark, d, "documents").groupBy("source").agg(F.min("text").alias("text")).where("source IS NOT NULL")
    files = [
        ("AGENTS.md", "Run `pytest -q {w}` in {v} first.\n\n```\n$ make check && rm {w}\nls {v}\n```\n"), ("README.md", "see {v}\n\n    python3 -m pytest -q {w} | tail\n"), ("package.json", '{"scripts": {"test": "jest {w}", "check": "echo Error: no test specified"}}'),
        ("pnpm-lock.yaml", "{h}"), ("Makefile", "{w}: all\n\tx\ncheck: all\n\tx\ntest:\n\ty\nci := 3\n"), ("Cargo.toml", "[{w}]"),
    ]
    made = F.array(*(F.struct(F.lit(a).alias("path"), _filled(F.lit(b)).alias("text")) for a, b in files))
    rows = _named(repos, F.col("text")).select(F.concat(F.lit("r"), "source").alias("repo"), F.explode(made).alias("f")).select("repo", "f.*")
    return checks.declared_checks(rows).select("repo", F.col("place").alias("n"), "command", "source", "strength")


@query("""WITH p AS (SELECT event_id, event_type || '/u' || user_id || '/a_b' || json_extract_string(props, '$.k') || '.test.py' AS path, 'a_b' || json_extract_string(props, '$.k') AS stem FROM events)
  SELECT event_id, path, CASE n WHEN 0 THEN path WHEN 1 THEN stem || '.test.py' ELSE stem END AS key FROM p CROSS JOIN (VALUES (0), (1), (2)) v(n)""")
def q88_entity_keys(spark, d):
    path = F.concat("event_type", F.lit("/u"), F.col("user_id").cast("string"), F.lit("/a_b"), F.get_json_object("props", "$.k"), F.lit(".test.py"))
    paths = table(spark, d, "events").select("event_id", path.alias("path"))
    return merge.entity_keys(paths.select("event_id", "path", F.lit("path").alias("kind"), F.col("path").alias("value"))).select("event_id", "path", "key")


@query(None)
def q71b_contains_secret(spark, d):
    return table(spark, d, "documents").select("doc_id", redaction.contains_secret(F.col("text")).alias("secret"))
