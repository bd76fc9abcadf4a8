"""The store's facts against plain folds, whatever the order in which they come."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import store

START = datetime.datetime(2024, 1, 1)
SERVING = ("active", "stale", "candidate")
ALL = (*SERVING, "archived", "quarantined", "retired")


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def frame(spark, table, rows):
    return spark.createDataFrame(rows, store.SCHEMAS[table])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def plain_states(revisions, states):
    """State and accepted facts by one walk through time."""
    now, taken = {}, []
    for p, r, *_, state, when in sorted(revisions, key=lambda x: x[-1]):
        now.setdefault((p, r), [state, when])
    for p, r, state, learned, when in sorted(states, key=lambda x: (x[4], x[3], x[2])):
        have = now.get((p, r))
        if have is None or when < have[1]:
            continue
        if not learned or have[0] in SERVING:
            have[0] = state
            taken.append((p, r, state, learned, when))
    return {k: v[0] for k, v in now.items()}, taken


@pytest.fixture(scope="module")
def facts():
    rng = random.Random(6)
    revisions = [(f"p{p}", r, f"f{p}", f"r{p % 3}", "t", rng.choice(ALL), at(rng.randint(0, 50))) for p in range(12) for r in range(1, 4)]
    times = list(range(20, 320))
    rng.shuffle(times)
    states = [(f"p{rng.randint(0, 13)}", rng.randint(1, 3), rng.choice(ALL), rng.random() < 0.8, at(t)) for t in times]
    return revisions, states


def test_states_equal_a_plain_fold(spark, facts):
    revisions, states = facts
    want, taken = plain_states(revisions, states)
    for order in (states, states[::-1], states + states[:40]):  # any order, and some said twice
        r, s = frame(spark, "revisions", revisions), frame(spark, "states", order).repartition(5)
        assert {(x["procedure"], x["revision"]): x["state"] for x in store.current_states(s, r).collect()} == want
    got = store.accepted(frame(spark, "states", states), frame(spark, "revisions", revisions)).where("accepted")
    assert rows(got, "procedure", "revision", "state", "learned", "at") == sorted(taken, key=str)


def test_a_decision_before_a_retirement_comes_too_late(spark, tmp_path):
    """Read, retired meanwhile, then written: the retirement holds, in whatever order the batches come."""
    for n, order in enumerate((("retire", "decide"), ("decide", "retire"))):
        s = store.Store(spark, str(tmp_path / str(n)))
        s.append("revisions", frame(spark, "revisions", [("p", 1, "f", "r", "t", "stale", at(0))]), "a")
        batches = {"retire": store.retirement(s.read("revisions"), "p", F.lit(at(10))), "decide": frame(spark, "states", [("p", 1, "active", True, at(20))])}
        for name in order:
            s.append("states", batches[name], name)
        t = s.tables()
        assert store.current_states(t["states"], t["revisions"]).first()["state"] == "retired"


def test_the_first_extraction_counts(spark):
    facts = [("s", 1, "b", None, None, "x", None, 1, None, None, at(5)), ("s", 1, "a", "p", 1, None, None, 2, None, None, at(3)), ("s", 2, "c", None, None, "y", None, 3, None, None, at(4)), ("s", 1, "c", None, None, "z", None, 1, None, None, at(9))]
    want = [("s", 1, "a", 2), ("s", 2, "c", 3)]
    for order in (facts, facts[::-1], facts + facts):
        assert rows(store.first_of(frame(spark, "extractions", order), "session", "first_seq"), "session", "first_seq", "summary", "tool_calls") == want
    assert rows(store.rejections(frame(spark, "extractions", facts), 5), "session", "first_seq", "rejection") == [("s", 2, "y")]


def test_injections_settle_once_each(spark):
    injections = frame(spark, "injections", [("i", "s", "p", 1, False, "prompt", at(1)), ("j", "s", "p", 1, True, "prompt", at(2)), ("k", "t", "p", 2, False, "failure", at(3)), ("i", "s", "p", 1, False, "prompt", at(1))])
    settlements = frame(spark, "settlements", [("i", 0, "failed", at(5)), ("i", 0, "succeeded", at(6)), ("j", 0, "failed", at(5)), ("k", 4, "unjudged", at(9))])
    settled = store.settled_injections(injections, settlements, frame(spark, "reminders", [("i", at(4)), ("i", at(3))]))
    assert rows(settled, "injection", "task", "outcome", "reminded_at") == [("i", 0, "succeeded", at(4)), ("j", 0, "failed", None), ("k", 4, "unjudged", None)]
    assert rows(store.outcome_totals(settled), "procedure", "revision", "successes", "failures", "injections", "holdouts", "last_success_at") == [("p", 1, 1, 0, 1, 1, at(1)), ("p", 2, 0, 0, 1, 0, None)]
    revisions = frame(spark, "revisions", [("p", 1, "f", "r", "t", "active", at(0)), ("p", 2, "f", "r", "t", "candidate", at(7)), ("p", 3, "f", "r", "t", "retired", at(8))])
    assert rows(store.evidence(revisions, settled), "procedure", "revision", "s", "f", "hs", "hf") == [("p", 1, 1, 0, 0, 1), ("p", 2, 0, 0, 0, 1), ("p", 3, 0, 0, 0, 1)]
    assert rows(store.usage(revisions, settled), "procedure", "revision", "used_at") == [("p", 1, at(2)), ("p", 2, at(3))]


def test_settlement_decides_and_a_second_run_changes_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.append("revisions", frame(spark, "revisions", [("bad", 1, "f", "r", "t", "active", at(0)), ("old", 1, "g", "r", "t", "active", at(-86400 * 40)), ("good", 1, "h", "r", "t", "active", at(0))]), "a")
    s.append("injections", frame(spark, "injections", [(f"{p}{n}", "s", p, 1, False, "prompt", at(n)) for p in ("bad", "good") for n in range(8)]), "a")
    settlements = frame(spark, "settlements", [(f"{p}{n}", 0, "failed" if p == "bad" else "succeeded", at(n + 1)) for p in ("bad", "good") for n in range(8)])
    for _ in range(2):
        decided = s.settle(settlements, F.lit(at(100)), "b")
        state = {r["procedure"]: r["state"] for r in store.current_states(s.tables()["states"], s.tables()["revisions"]).collect()}
        assert state == {"bad": "quarantined", "old": "stale", "good": "active"}
        assert rows(decided, "procedure", "state") == [("bad", "quarantined"), ("old", "stale")]


def test_forgetting_reaches_all_tables(spark, tmp_path):
    def filled():
        return {
            "revisions": [("p", 1, "f", "r", "t", "active", at(1)), ("q", 1, "g", "r", "t", "active", at(1)), ("o", 1, "h", "z", "t", "active", at(1)), ("p", 1, "f", "r", "t", "active", at(50))],
            "extractions": [("s", n, "x", p, 1, None, None, 1, None, None, at(2)) for n, p in enumerate(("p", "q", "o"))] + [("s", 9, "x", None, None, "no edits", None, 1, None, None, at(2))],
            "injections": [(f"i{p}", "s", p, 1, False, "prompt", at(3)) for p in ("p", "q", "o")],
            "settlements": [(f"i{p}", 0, "failed", at(4)) for p in ("p", "q", "o")],
            "reminders": [("ip", at(5))],
            "states": [("p", 1, "stale", True, at(6))],
            "progress": [("s", "h", "t", "r", 1, False, at(1)), ("u", "h", "t", "r", 1, False, at(60))],
        }

    cases = {
        ("procedure", "p"): ({"o", "p", "q"}, {"io", "iq"}, {1, 2, 9}, 1, {"s", "u"}, {"io", "iq"}, 0),
        ("repo", "r"): ({"o", "p"}, {"io"}, {2, 9}, 1, {"s", "u"}, {"io"}, 0),
        ("all", None): ({"p"}, set(), set(), 1, {"u"}, set(), 0),
        ("session", "s"): ({"o", "p", "q"}, {"io", "ip", "iq"}, {0, 1, 2, 9}, 2, {"u"}, {"io", "ip", "iq"}, 1),
    }
    for n, ((what, value), want) in enumerate(cases.items()):
        s = store.Store(spark, str(tmp_path / str(n)))
        for table, facts in filled().items():
            s.append(table, frame(spark, table, facts), "a")
        s.append("forgotten", frame(spark, "forgotten", [(what, value, at(20))]), "b")
        t = s.tables()
        ids = lambda name, c: {r[0] for r in t[name].select(c).collect()}  # noqa: B023, E731
        got = (ids("revisions", "procedure"), ids("injections", "injection"), ids("extractions", "first_seq"), t["revisions"].where("procedure = 'p'").count(), ids("progress", "session"), ids("settlements", "injection"), t["reminders"].count())
        assert got == want, what


def test_progress(spark):
    facts = [("s", "h", "t1", None, 1, False, at(1)), ("s", "h2", "t2", "r", 2, False, at(2)), ("u", "h", "t", None, None, False, at(1)), ("s", None, None, None, None, True, at(3)), ("v", None, None, None, None, True, at(3))]
    for order in (facts, facts[::-1]):
        now = store.current_progress(frame(spark, "progress", order))
        assert rows(now, "session", "harness", "transcript", "repo", "extracted_through", "ended", "updated_at") == [("s", "h", "t2", "r", 2, True, at(3)), ("u", "h", "t", None, None, False, at(1))]
        assert rows(store.open_sessions(now, "h"), "session") == [("u",)]
