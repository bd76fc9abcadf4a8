"""Two procedures as one: answers by hand, and that the order of merging doesn't matter."""

import itertools

import pytest

from tracemill.operators.generalize import hint, is_number, unified, with_values


def procedure(*commands, check=None, **slots):
    return {"steps": [["run", None, c] for c in commands], "verify": check, "slots": {n: {"kind": "identifier", "examples": list(x)} for n, x in slots.items()}}


def commands(p):
    return None if p is None else [c for _, _, c in p["steps"]]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("make x", "make x", "make x"),
        ("make  x", "make  x", "make  x"),
        ("new --name a b", "new --name c b", "new --name {name} b"),
        ("new --Dry-Run a", "new --Dry-Run b", "new --Dry-Run {dry_run}"),
        ("new --name=a", "new --name=b", "new --name={name}"),
        ("env A=1 x", "env A=2 x", "env A={a} x"),
        ("env A=1 x", "env B=2 x", "env {arg} x"),
        ("cargo test one", "cargo test two", "cargo test {test}"),
        ("bin/pytest -k a", "bin/pytest -k b", "bin/pytest -k {k}"),
        ("bin/pytest a", "bin/pytest b", "bin/pytest {test}"),
        ("go a b", "go c d", "go {arg} {arg_2}"),
        ("go a a", "go b b", "go {arg} {arg}"),
        ("go -- a", "go -- b", "go -- {arg}"),
        ("go a b c", "go x y z", None),
        ("go -a", "go -b", None),
        ("go a", "go -b", None),
        ("go a", "went a", None),
        ("go a", "go a b", None),
        ("find -exec fmt a +", "find -exec fmt {} +", None),
        ("", " ", ""),
    ],
)
def test_commands(a, b, want):
    assert commands(unified(procedure(a), procedure(b))) == (None if want is None else [want])


def test_slots_that_are_there():
    a, b = procedure("apply m/01_a.sql", migration=["01_a"]), procedure("apply m/02_b.sql", migration=["02_b"])
    both = unified(a, b)
    assert (commands(both), list(both["slots"])) == (["apply m/{migration}.sql"], ["migration"])
    # a template meets a literal, from either side
    general = unified(procedure("t one"), procedure("t two"))
    for merged in (unified(general, procedure("t three")), unified(procedure("t three"), general)):
        assert commands(merged) == ["t {arg}"]
        assert merged["slots"]["arg"]["examples"] == ["one", "two", "three"]
    assert unified(general, procedure("t {x}")) is None
    assert unified(procedure("t a{arg}b", arg=["1"]), procedure("t ab")) is None
    assert commands(unified(procedure("t a{arg}b", arg=["1"]), procedure("t a22b"))) == ["t a{arg}b"]


def test_the_check_may_differ_and_shares_its_steps_slots():
    a, b, c = (procedure(f"cargo test {x}", check=f"cargo test {y}") for x, y in (("one", "one"), ("two", "two"), ("three", "four")))
    both = unified(a, b)
    assert (commands(both), both["verify"], len(both["slots"])) == (["cargo test {test}"], "cargo test {test}", 1)
    apart = unified(both, c)
    assert (commands(apart), apart["verify"]) == (["cargo test {test}"], "cargo test {test_2}")
    assert [s["examples"] for s in apart["slots"].values()] == [["one", "two", "three"], ["one", "two", "four"]]
    assert unified(procedure("x", check="make a"), procedure("x", check="tox"))["verify"] == "make a"
    assert unified(procedure("x", check="make a"), procedure("x"))["verify"] == "make a"


def test_steps_must_agree():
    edit = {"steps": [["edit", "a", None]], "verify": None, "slots": {}}
    assert unified(edit, edit)["steps"] == edit["steps"]
    for other in ([["edit", "b", None]], [["create", "a", None]], [["edit", "a", "x"]], [], [["edit", "a", None]] * 2):
        assert unified(edit, {**edit, "steps": other}) is None
    assert commands(unified(procedure("a x", "b y"), procedure("a x", "c y"))) is None


def test_kinds_and_examples():
    assert [is_number(x) for x in ("1", "-1.5e3", ".5", "inf", "NaN", "1_0", "٣", "a", "")] == [True] * 5 + [False] * 4
    slot = {"kind": "number", "examples": []}
    assert [with_values(slot, v)["kind"] for v in (["1"], ["1", "a"], ["1", "a/b"])] == ["number", "identifier", "path"]
    assert with_values({"kind": "path", "examples": []}, ["1"])["kind"] == "path"
    assert with_values({"kind": "number", "examples": ["0"]}, list("0123456"))["examples"] == list("01234")
    assert [hint([*w], [], "") for w in (["a", "--b-c"], ["a", "--"], ["a", "-b=c"], ["a", "---"])] == ["b_c", "arg", "arg", "arg"]


def shape(p):
    """A procedure without the names of its slots."""
    if p is None:
        return None
    text = "\n".join([*commands(p), p["verify"]])
    used = sorted((n for n in p["slots"] if f"{{{n}}}" in text), key=lambda n: text.index(f"{{{n}}}"))
    assert len(used) == len(p["slots"])
    for i, n in enumerate(used):
        text = text.replace(f"{{{n}}}", f"{{{i}}}")
    return text, [(p["slots"][n]["kind"], sorted(p["slots"][n]["examples"])) for n in used]


def test_order_does_not_matter():
    given = []
    for test, folder, release in itertools.product(["count", "total", "out"], ["out", "build/out", "total"], ["", "--release "]):
        check = f"cargo test {release}{test}"
        given.append(procedure(f"mkdir {folder}", f"new.py --name={test} {folder}", check, check=check))
    merge = lambda a, b: None if a is None or b is None else unified(a, b)
    seen = set()
    for a, b, c in itertools.product(given, repeat=3):
        found = [shape(m) for x, y, z in ((a, b, c), (a, c, b), (b, c, a)) for m in (merge(merge(x, y), z), merge(x, merge(y, z)))]
        assert all(f == found[0] for f in found)
        seen.add(found[0] is None)
    assert seen == {True, False}
