"""Two procedures as one that is general enough for both.

Commands are laid side by side, and what differs is gathered first, as places. Names are dealt to places afterwards, one to each
distinct pair of values, and slots are written from the places of each name. So no rule has to undo what another did: a check that has
no common form just adds no places.

Procedures are dicts: steps ([kind, target, command] each), verify (a command or null) and slots ({name: {"kind", "examples"}}); {name} in a word
stands for a slot.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

MOST_DIFFERING = 2
MOST_EXAMPLES = 5
# Programs after which a slot is a test, and the kinds of slots from narrow to wide.
TEST_RUNNERS = ("test", "pytest", "jest", "vitest", "rspec", "mocha")
NUMBER, IDENTIFIER, PATH = "number", "identifier", "path"


class Place(NamedTuple):
    """Where two words differ: the text around it, the values (a slot's mark on the side that has it), and that slot's name and record."""

    left: str
    right: str
    values: tuple[str, str]
    hint: str
    slot: str | None = None
    known: dict | None = None

    def literals(self) -> list[str]:
        return [v for v in self.values if self.slot is None or v != mark(self.slot)]


def mark(name: str) -> str:
    return f"{{{name}}}"


def hint(words: list[str], others: list[str], key: str) -> str:
    """What a slot behind these words is called: by its option, as a test's name, or just as an argument."""
    option = key or next((w for w in words[-1:] if re.fullmatch(r"-+[^-=][^=]*", w)), "")
    if option:
        return re.sub("[^A-Za-z0-9]", "_", option.lstrip("-")).lower()
    programs = {w.rsplit("/", 1)[-1] for w in words + others}
    return "arg" if programs.isdisjoint(TEST_RUNNERS) else "test"


def in_shared_slot(a: str, b: str, mine: dict, theirs: dict) -> str | None:
    """The word that both become when an example of a slot that both procedures have is put back into its slot."""
    pairs = ((mark(n), x, y) for n in mine if n in theirs for x in mine[n]["examples"] for y in theirs[n]["examples"])
    return next((w for m, x, y in pairs if m in (w := a.replace(x, m, 1)) and w == b.replace(y, m, 1)), None)


def differing(a: str, b: str, name: str, mine: dict, theirs: dict) -> Place | str | None:
    """Two words that differ, as a place, as a word with a slot of both, or null if nothing stands for both."""
    if "{" not in a + b:
        return in_shared_slot(a, b, mine, theirs) or Place("", "", (a, b), name)
    general, literal, slots = (a, b, mine) if "{" in a else (b, a, theirs)
    if "{" in literal or general.count("{") > 1:
        return None
    for slot, known in slots.items():
        left, _, right = general.partition(mark(slot))
        if left != general and (m := re.fullmatch(f"{re.escape(left)}(.+){re.escape(right)}", literal, re.S)):
            values = (mark(slot), m[1]) if general is a else (m[1], mark(slot))
            return Place(left, right, values, name, slot, known)
    return None


def side_by_side(a: str, b: str, mine: dict, theirs: dict) -> list[Place | str] | None:
    """Two commands as words and places; null if their first words, their numbers of words or too many words differ, or a flag does."""
    if a == b:
        return [a]
    x, y = a.split(), b.split()
    odd = [i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q]
    if len(x) != len(y) or len(odd) > MOST_DIFFERING or x[:1] != y[:1]:
        return None
    out: list[Place | str] = list(x)
    for i in odd:
        key, other = x[i].partition("="), y[i].partition("=")
        option = key[0] if key[1] and other[1] and key[0] == other[0] else None
        if option is None and "-" in (x[i][0], y[i][0]):
            return None
        pair = (x[i], y[i]) if option is None else (key[2], other[2])
        found = differing(*pair, hint(x[:i], y[:i], option or ""), mine, theirs)
        if found is None:
            return None
        head = "" if option is None else f"{option}="
        out[i] = found._replace(left=head + found.left) if isinstance(found, Place) else head + found
    return out


def names_of(places: list[Place], mine: dict, theirs: dict) -> dict[tuple[str, str], str]:
    """A slot's name for each pair of values: that of the slot it came from unless another pair took it, else one that is free."""
    out: dict[tuple[str, str], str] = {}
    for p in places:
        if p.values in out:
            continue
        free = itertools.chain([p.hint], (f"{p.hint}_{n}" for n in itertools.count(2)))
        taken = {*mine, *theirs, *out.values()}
        out[p.values] = p.slot if p.slot and p.slot not in out.values() else next(n for n in free if n not in taken)
    return out


def is_number(value: str) -> bool:
    try:
        float(value)
    except ValueError:
        return False
    return value.isascii() and "_" not in value


def with_values(slot: dict, values: list[str]) -> dict:
    """A slot that has met more values: its kind is wide enough for all, and the first MOST_EXAMPLES distinct ones are kept."""
    kind = slot["kind"]
    if any("/" in v for v in values):
        kind = PATH
    elif kind == NUMBER and not all(map(is_number, values)):
        kind = IDENTIFIER
    return {"kind": kind, "examples": [*slot["examples"], *dict.fromkeys(v for v in values if v not in slot["examples"])][: max(MOST_EXAMPLES, len(slot["examples"]))]}


def unified(a: dict, b: dict) -> dict | None:
    """Procedure a, made general enough for b; null if their steps differ in more than slots can stand for."""
    mine, theirs = a["slots"], b["slots"]
    if [(k, t, c is None) for k, t, c in a["steps"]] != [(k, t, c is None) for k, t, c in b["steps"]]:
        return None
    lines = [[] if x[2] is None else side_by_side(x[2], y[2], mine, theirs) for x, y in zip(a["steps"], b["steps"], strict=True)]
    if None in lines:
        return None
    check = None if a["verify"] is None or b["verify"] is None else side_by_side(a["verify"], b["verify"], mine, theirs)
    places = [p for line in [*lines, check or []] for p in line if isinstance(p, Place)]
    names = names_of(places, mine, theirs)
    slots = {n: {"kind": s["kind"], "examples": list(s["examples"])} for n, s in mine.items()}
    first: dict[tuple[str, str], Place] = {}
    for p in places:
        first.setdefault(p.values, p)
    for values, p in first.items():
        known = p.known or {"kind": NUMBER, "examples": []}
        slot = slots.get(names[values], {"kind": known["kind"], "examples": []})
        slots[names[values]] = with_values(slot, [*known["examples"], *p.literals()])

    def written(line: list[Place | str]) -> str:
        return " ".join(w if isinstance(w, str) else f"{w.left}{mark(names[w.values])}{w.right}" for w in line)

    steps = [[kind, target, None if command is None else written(line)] for (kind, target, command), line in zip(a["steps"], lines, strict=True)]
    return {**a, "steps": steps, "verify": a["verify"] if check is None else written(check), "slots": slots}
