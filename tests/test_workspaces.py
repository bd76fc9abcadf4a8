"""Roots, identities and commits in hard cases, and as-of joins against a plain search."""

import datetime as dt
import random

from tracemill.operators import workspaces


def test_remotes(spark):
    same = ["git@Git.Example.org:a/b.git", "https://git.example.org/a/b", "ssh://git@git.example.org:22/a/b.git/", " https://u:p@GIT.example.org/a/b/ "]
    others = {"/srv/git/a.git": "/srv/git/a", "./a:b": "/./a:b", "https://h.example": "h.example/", "": "/", "h:a.git.git": "h/a.git"}
    rows = spark.createDataFrame([(u,) for u in [*same, *others, None]], "url string")
    got = {r.url: r.x for r in rows.select("url", workspaces.normalized_remote(rows.url).alias("x")).collect()}
    assert {got[u] for u in same} == {"git.example.org/a/b"} and {u: got[u] for u in others} == others and got[None] is None


def test_hash(spark):
    def plain(text):
        h = 0xCBF29CE484222325
        for byte in text.encode():
            h = (h ^ byte) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "foobar", "naïve 語", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.h for r in rows.select(workspaces.fnv64(rows.t).alias("h")).collect()] == [plain(t) for t in texts]


def test_roots(spark):
    files = [("/", "Makefile"), ("/h/u/w", "Cargo.toml"), ("/h/u", ".git"), ("/h/u/w/a", ".hg"), ("/h/u/w/a/b", "go.mod"), ("/p", "readme"), ("/q", ".git"), ("/q/r", "go.mod"), ("/q/r", "go.mod")]
    cwds = ["/h/u/w/a/b/c", "/h/u/w/z", "/h/u", "/p/x", "/q/r/s", "/", None, "/q/r/s"]
    found = spark.createDataFrame(files, "dir string, name string")
    given = spark.createDataFrame([(c,) for c in cwds], "cwd string")
    got = {r.cwd: r.root for r in workspaces.project_roots(given, found).collect()}
    assert got == {"/h/u/w/a/b/c": "/h/u", "/h/u/w/z": "/h/u", "/h/u": "/h/u", "/p/x": "/p/x", "/q/r/s": "/q", "/": "/"}
    below = {r.cwd: r.root for r in workspaces.project_roots(given, found, home="/h/u").collect()}
    assert below == {**got, "/h/u/w/a/b/c": "/h/u/w/a", "/h/u/w/z": "/h/u/w"}


def test_identities(spark):
    roots = spark.createDataFrame([("/a", True, False), ("/b", True, False), ("/c", True, True), ("/d", False, True), ("/e", True, True)], "root string, has_head boolean, shallow boolean")
    commits = spark.createDataFrame([("/a", "f2"), ("/a", " 0a\n"), ("/b", "0a"), ("/c", "1"), ("/b", " ")], "root string, commit string")
    remotes = spark.createDataFrame([("/c", "fork", 0, "https://x.example/y"), ("/c", "origin", 1, "git@z.example:y.git"), ("/d", "origin", 0, "u")], "root string, name string, place int, url string")
    got = {r.root: r.repo for r in workspaces.repository_ids(roots, commits, remotes).collect()}
    assert got["/a"] == got["/b"] == "0a" and got["/c"].startswith("remote-") and got["/d"].startswith("path-") and got["/e"].startswith("path-")
    assert len({got[x] for x in ("/c", "/d", "/e")}) == 3


def test_commit_at(spark):
    draw = random.Random(7)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    when = lambda: start + dt.timedelta(seconds=draw.randrange(40_000))
    logs = [("hot" if n % 3 else f"r{n % 4}", when(), n, f"c{n}") for n in range(300)]
    logs += [(logs[0][0], logs[0][1], 900, "same time, older entry"), (None, start, 0, "no root")]
    moments = [(draw.choice(["hot", "r0", "r1", "none"]), when(), n) for n in range(300)] + [("hot", logs[1][1], -1), ("r0", None, -2), (None, start, -3)]
    reflog = spark.createDataFrame(logs, "root string, at timestamp, place int, commit string")
    asked = spark.createDataFrame(moments, "root string, at timestamp, `a.b` int")
    got = {r["a.b"]: r["head"] for r in workspaces.commit_at(asked, reflog, block_seconds=1800).collect()}
    want = {n: min(((p, c) for r, t, p, c in logs if r == root and at is not None and t <= at), default=(0, None))[1] for root, at, n in moments}
    assert got == want
    assert workspaces.commit_at(asked, reflog.limit(0)).where("head IS NOT NULL").count() == 0
