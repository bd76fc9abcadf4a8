"""Shell commands: one small lexer, and what the engine wants to know of a command as one struct column.

A command is cut by quotes, escapes, heredocs and operators with one regular expression; each question is then a few lines over its
words. Commands repeat a lot, so a worker keeps the answers for those it met last.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import fixed

QUOTED = r"""'[^']*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)"""
CUT = r"&&|\|\||\|&|[|;\n]|(?<!>)&(?!>)"
PART = re.compile(rf"(?P<quoted>{QUOTED})|(?P<escape>\\.?)|(?P<cut>{CUT})|(?P<gap>[^\S\n]+)|(?P<plain>[^\s'\"\\|;&]+|&)", re.S)
BODY = re.compile(rf"(?P<quoted>{QUOTED})|\\.|<<<|<<(?P<tabs>-?)[ \t]*(?P<mark>['\"]?)(?P<end>[^\s'\";&|<>()]*)(?P=mark)?|(?P<line>\n)", re.S)
FILTERED = re.compile(fixed.TRAILING_FILTER.removesuffix("$") + r"\Z")
CHECK_WORD, OUTPUT_CHECK_WORD, TEST_WORD, FULL_CHECK = (re.compile(p.replace("|$", r"|\Z").replace("$|", r"\Z|")) for p in (fixed.CHECK_WORD, fixed.OUTPUT_CHECK_WORD, fixed.TEST_WORD, fixed.FULL_CHECK))
VALUES = {k: frozenset(v.split()) for k, v in fixed.VALUE_OPTIONS.items()}

FIELDS = {
    "text": "string", "program": "string", "action": "string", "argv": "array<string>", "executables": "array<string>", "is_check": "boolean", "runs_tests": "boolean",
    "clean": "string", "clean_program": "string", "hides_status": "boolean", "masked": "boolean", "output_check": "boolean", "builds": "boolean", "is_setup": "boolean",
    "is_task": "boolean", "strength": "int", "words": "string", "tool": "string", "required": "array<string>",
}


def without_bodies(command: str) -> str:
    """A command without heredoc bodies; quotations over lines or of more than QUOTED_CHARS characters become '...'."""
    out, waiting, at = [], [], 0
    while m := BODY.search(command, at):
        out.append(command[at : m.start()])
        at = m.end()
        if m["quoted"]:
            mark, inner = m[0][0], m[0][1:]
            closed = len(inner) > 0 and inner[-1] == mark and not (mark == '"' and re.search(r'(?<!\\)(?:\\\\)*\\"\Z', inner))
            inner = inner[:-1] if closed else inner
            out.append(mark + ("..." if "\n" in inner or len(inner) > fixed.QUOTED_CHARS else inner) + (mark if closed else ""))
        elif m["line"] and waiting:
            for end, tabs in waiting:
                found = re.compile(rf"^{chr(92) + 't*' if tabs else ''}{re.escape(end)}$", re.M).search(command, at)
                if not found:
                    at = len(command)
                    break
                out.append("\n" + found[0])
                at = min(len(command), found.end() + 1)
            waiting = []
            if at < len(command):
                out.append("\n")
        else:
            out.append(m[0])
            if m["end"]:
                waiting.append((m["end"], m["tabs"]))
    return "".join([*out, command[at:]]).rstrip()


def normalized(command: str, cwd: str = "") -> str:
    """Without bodies, with the working directory as '.', and without a leading change to it."""
    text, cwd = without_bodies(command.strip()), cwd.rstrip("/")
    if len(cwd) > 1:
        around = r"""\s'"=;&|()<>`"""
        text = re.sub(rf"(?:^|(?<=[{around}])){re.escape(cwd)}(?=\Z|[/:{around}])", ".", text)
    for start in ("cd . && ", "cd . ; ", "cd .; "):
        if text.startswith(start):
            text = text[len(start) :].lstrip()
    return text


def simple_commands(text: str) -> list[tuple[list[str], str, str]]:
    """(words, source, the operator behind) of each simple command, in order."""
    out, words, word, begin = [], [], None, 0
    for m in PART.finditer(text):
        if m["gap"] or m["cut"]:
            words += [] if word is None else [word]
            word = None
            if m["cut"]:
                out.append((words, text[begin : m.start()], m["cut"]))
                words, begin = [], m.end()
        elif m["quoted"]:
            inner = m[0][1:-1] if len(m[0]) > 1 and m[0][-1] == m[0][0] else m[0][1:]
            word = (word or "") + (re.sub(r"\\(.)", r"\1", inner, flags=re.S) if m[0][0] == '"' else inner)
        elif m["escape"]:
            word = word if m[0] == "\\\n" else (word or "") + m[0][1:]
        else:
            word = (word or "") + m[0]
    return [*out, (words if word is None else [*words, word], text[begin:], "")]


def first_words(text: str) -> tuple[list[list[str]], list[str]]:
    """Leading directory changes, and the words of the first command that is none."""
    changes: list[list[str]] = []
    for words, _, cut in simple_commands(text):
        if (words and words[0] != "cd") or cut in ("|", "||", "|&", "&", ""):
            return changes, words
        changes += [words] if words else []
    return changes, []


def base(word: str) -> str:
    name = word.rsplit("/", 1)[-1]
    return {"gradlew": "gradle", "mvnw": "mvn"}.get(name, name)


def _operand(program: str, words: list[str], at: int) -> int:
    """Where the next word stands that is no option, value of one, or number."""
    while at < len(words):
        if words[at] == "--":
            return at + 1
        if not re.match(r"[-+0-9]", words[at]):
            break
        at += 2 if words[at] in VALUES.get(program, ()) else 1
    return at


def _subcommand(program: str, arguments: list[str]) -> str | None:
    at = _operand(program, arguments, 0) if program in fixed.SUBCOMMAND_PROGRAMS else len(arguments)
    return arguments[at] if at < len(arguments) else None


def layers(text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(launcher, its word) of each program that only starts another, and the words of the last."""
    words, launchers = first_words(text)[1], []
    while True:
        while words and re.match(r"[A-Za-z_][A-Za-z0-9_]*=", words[0]):
            words = words[1:]
        if not words:
            return launchers, words
        name, sub = base(words[0]), _subcommand(base(words[0]), words[1:])
        start = 1 if sub is None else 2 + _operand(name, words[1:], 0)
        name = name if sub is None else f"{name} {sub}"
        at = _operand(name, words, start) if name in (*fixed.WRAPPERS, *fixed.PACKAGE_RUNNERS) else len(words)
        if at >= len(words):
            return launchers, words
        launchers.append((name, words[0]))
        words = words[at:]


def program_of(argv: list[str]) -> str:
    if not argv:
        return ""
    name, rest = base(argv[0]), argv[1:]
    if (sub := _subcommand(name, rest)) is not None:
        return f"{name} {sub}"
    if name.startswith("python"):
        return f"python -m {rest[1]}" if len(rest) > 1 and rest[0] == "-m" else " ".join(["python", *rest[:1]])
    return name


def cleaned(command: str) -> str:
    """A command without trailing filters."""
    command, before = command.strip(), None
    while command != before:
        before, command = command, FILTERED.sub("", command, 1).rstrip()
    return command


def _action(program: str, argv: list[str]) -> str:
    name = program.split(" ")[0]
    in_place = {"sed": lambda x: x.startswith("--in-place") or (x[:1] == "-" and x[:2] != "--" and "i" in x), "awk": lambda x: "inplace" in x, "gawk": lambda x: "inplace" in x}
    if name in fixed.READERS or (name in in_place and not any(map(in_place[name], argv[1:]))):
        return "read"
    return "search" if name in fixed.SEARCHERS or program == "git grep" else "run"


def _check_script(script: str, task: str) -> bool:
    return bool(CHECK_WORD.search(script) or (task and task[0] != "-" and not re.search("[/.]", task) and CHECK_WORD.search(task)))


def _is_check(command: str) -> bool:
    argv = layers(normalized(cleaned(command)))[1]
    if not argv or any(x.split("=")[0] in fixed.NO_RUN_FLAGS for x in argv[1:]):
        return False
    program, rest = program_of(argv), argv[1:]
    runner, at = program.split(" ")[0], 0
    if program in fixed.CHECK_PROGRAMS:
        return True
    if program == "node":
        return "--test" in rest
    if program == "cargo nextest":
        return "run" in rest or "r" in rest
    if program in fixed.SCRIPT_RUNNERS or runner in ("make", "just", "rake", *fixed.SHELLS):
        return bool(CHECK_WORD.search(" ".join(rest)))
    if runner in ("mvn", "gradle"):
        while (at := _operand(base(argv[0]), rest, at)) < len(rest):
            if f"{runner} {rest[at].rsplit(':', 1)[-1]}" in fixed.CHECK_PROGRAMS:
                return True
            at += 1
        return False
    if program.startswith("python "):
        return _check_script(program, rest[1] if len(rest) > 1 else "")
    return "/" in argv[0] and _check_script(argv[0], rest[0] if rest else "")


def _hides_status(command: str) -> bool:
    """Whether something other than && follows the first command that is no change of directory."""
    parts = simple_commands(command)
    at = next((n for n, (_, source, cut) in enumerate(parts) if source.split()[:1] != ["cd"] or cut not in ("&&", ";", "\n")), len(parts))
    return any(a[2] != "&&" and b[1].strip() for a, b in zip(parts[at:], parts[at + 1 :], strict=False))


def _is_task(command: str, argv: list[str], program: str) -> bool:
    """Whether a command runs a task of the project that is neither a check nor setup."""
    if _is_check(command) or re.match(fixed.SETUP, command):
        return False
    first, second = (*argv, "", "")[:2]
    if program in fixed.SCRIPT_RUNNERS or program.split(" ")[0] in ("make", "just"):
        return True
    if program in fixed.SHELLS:
        return bool(second) and second[0] != "-"
    if program in ("node", "deno", "bun"):
        return second.endswith((".js", ".mjs", ".cjs", ".ts"))
    if program.startswith("python "):
        return not program.startswith("python -")
    return first.startswith(("./", "bin/", "scripts/"))


def _strength(command: str) -> int:
    """Of a check: 2 for one of everything, 1 for tests, 0 for a part (lint, types, build)."""
    program, target = program_of(layers(normalized(command))[1]), " ".join(command.split()[1:])
    if FULL_CHECK.search(program) or FULL_CHECK.search(target):
        return 2
    return 0 if "lint" in re.split(r"[\W_]", target) or program in fixed.PARTIAL_PROGRAMS else 1


def check_words(command: str) -> str:
    """What two spellings of one check have in common."""
    return " ".join("python" if w == "python3" else w for w in normalized(cleaned(command)).split())


def _tool(argv: list[str]) -> str | None:
    """Base program and arguments, by which a command found elsewhere is known."""
    name = lambda w: w.rsplit("/", 1)[-1].rstrip("0123456789.")
    argv = argv[2:] if len(argv) > 2 and argv[1] == "-m" and name(argv[0]) == "python" else argv
    return "\x1f".join([name(argv[0]), *argv[1:]]) if argv and name(argv[0]) else None


def located(command: str, path: str) -> str | None:
    """Where a path that a normalized command names lies below the project; null if a change of directory leads out of it or can't be followed."""
    changes = first_words(command)[0]
    if path.startswith("~") or any(len(c) != 2 or c[1][:1] in ("/", "~", "-") for c in changes):
        return None
    parts = "/".join([*(c[1] for c in changes), path]).split("/")
    return "/".join(p for p in parts if p not in ("", "."))


def started(launchers: list[tuple[str, str]], argv: list[str]) -> list[str]:
    """The programs that a command starts itself: launchers, and what they start unless a package runner finds it."""
    runner = next((n for n, (x, _) in enumerate(launchers) if x in fixed.PACKAGE_RUNNERS), None)
    words = [w for _, w in launchers] + argv[:1] if runner is None else [w for _, w in launchers[: runner + 1]]
    return [w for w in words if w not in fixed.BUILTINS]


def required(command: str) -> list[str]:
    """What must be there for a command to start: program:name on the search path or file:path in the project."""
    text = normalized(command)
    needs = [(f"program:{w}" if w[:1] == "/" or "/" not in w else located(text, w)) for w in started(*layers(text))]
    return [n if n.startswith("program:") else f"file:{n}" for n in needs if n is not None]


@functools.lru_cache(20_000)
def analyzed(command: str, cwd: str = "") -> tuple:
    """The values of FIELDS for one command."""
    text, clean = normalized(command, cwd), cleaned(command)
    launchers, argv = layers(text)
    program, clean_program = program_of(argv), program_of(layers(normalized(clean))[1])
    script = argv[1:2] if program.split(" ")[0] in fixed.SHELLS else [w for w in argv[:1] if "/" in w]
    judged = program in fixed.OUTPUT_CHECK_PROGRAMS or program.split(" ")[0] in fixed.TASK_RUNNERS or any(OUTPUT_CHECK_WORD.search(w) for w in script)
    masked = any(cut not in ("&&", "") for _, _, cut in simple_commands(command))
    return (
        text, program, _action(program, argv), argv, started(launchers, argv), _is_check(command), bool(TEST_WORD.search(clean)), clean, clean_program, _hides_status(command),
        masked, judged, program in fixed.BUILD_PROGRAMS, bool(re.match(fixed.SETUP, command)), _is_task(command, argv, program), _strength(command), check_words(command), _tool(argv), required(clean),
    )


def _analyzed(commands: pd.Series, cwd: pd.Series) -> pd.DataFrame:
    rows = [analyzed(c, d or "") if isinstance(c, str) else (None,) * len(FIELDS) for c, d in zip(commands, cwd, strict=True)]
    return pd.DataFrame(rows, columns=list(FIELDS))


def _ran(checks: pd.Series, commands: pd.Series) -> pd.Series:
    def one(check: str, command: str) -> bool:
        want, got = check_words(check).split(), check_words(command).split()
        slot = r"\{[A-Za-z0-9_]+\}"

        def fills(a: str, b: str) -> bool:
            return a == b or bool(re.search(slot, a)) and not (a[0] == "{" and b[0] == "-") and re.fullmatch(".+".join(map(re.escape, re.split(slot, a))), b) is not None

        return len(want) == len(got) and all(map(fills, want, got))

    return pd.Series([None if not isinstance(a, str) or not isinstance(b, str) else one(a, b) for a, b in zip(checks, commands, strict=True)], dtype=object)


def analysis(command: Column, cwd: Column | None = None) -> Column:
    """struct(FIELDS) of a command; all fields of a null are null. Take it once, as a column, and read its fields."""
    udf = F.pandas_udf(_analyzed, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))
    return udf(command, F.lit("") if cwd is None else cwd)


def ran(check: Column, command: Column) -> Column:
    """Whether a command is a run of a check in which {slot} stands for a part of a word."""
    return F.pandas_udf(_ran, "boolean")(check, command)


def covers(passed: Column, failed: Column) -> Column:
    """Whether a pass of one analyzed check answers a failure of another: tests any tests, else the same program."""
    return F.when(failed["runs_tests"], passed["runs_tests"]).otherwise(passed["clean_program"] == failed["clean_program"])
