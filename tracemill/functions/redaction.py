"""Redaction of secrets.

Tokens of known form have patterns of their own. Secrets that only their name or surroundings give away (assignments,
options, cookies, passwords on command lines, hex digests, addresses, random tokens) need a decision for each match.
Generated code looks for the literals without which no rule matches; rows that have one go to Python, in Arrow
batches, the others stay as they are. Patterns are anchored at the ends of runs, so that no text takes more than linear time.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import fixed

MARK = "[REDACTED:"
# A literal of each known form; for those in any case, in lower case.
LITERALS = {
    "private-key": ("PRIVATE KEY",), "aws-access-key": ("AKIA", "ASIA", "ABIA", "ACCA"), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "gitlab-token": ("glpat-",), "slack-token": ("xox",), "slack-webhook": ("hooks.slack.com",), "stripe-key": ("k_live_", "k_test_"), "google-api-key": ("AIza",),
    "llm-api-key": ("sk-",), "npm-token": ("npm_",), "jwt": ("eyJ",), "url-password": ("://",), "auth-header": ("authorization",),
}
KEYWORDS = r"secret|token|pass|api[_.-]?key|access[_.-]?key|private[_.-]?key|credential"
FLAGS = r"secret|token|pass|passw(?:or)?d|passphrase|key|credentials?|auth|cookie"
VALUE = r""""[^"]*"|'[^']*'"""


def words_of(name: str) -> list[str]:
    """Lower-case words of a name in camel or snake case."""
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())


def _joined(name: str) -> str:
    return "".join(words_of(name)).rstrip("0123456789")


def _last(name: str) -> str:
    return (words_of(name) or [""])[-1]


def mentions_secret(name: str) -> bool:
    return any(w in _joined(name) for w in fixed.SECRET_WORDS) or re.search(r"token(?!s|iz)", _joined(name)) is not None or not set(words_of(name)).isdisjoint(fixed.PASS_WORDS)


def ends_with_secret(name: str) -> bool:
    return _joined(name).endswith((*fixed.SECRET_WORDS, "token", "credentials")) or _last(name) in fixed.PASS_WORDS or (_joined(name).endswith("key") and mentions_secret(name))


def plain_value(raw: str) -> str:
    """A value without quotes and closing punctuation."""
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        raw = raw[1:-1]
    raw = raw.rstrip(",;)]")
    return raw if "{" in raw else raw.rstrip("}")


def is_reference(value: str) -> bool:
    return re.fullmatch(r"\$(?:\{[A-Za-z_][A-Za-z0-9_]*\}|[A-Za-z_][A-Za-z0-9_]*)", value) is not None


def _generated(part: str) -> bool:
    digit, upper, lower = (re.search(p, part) for p in ("[0-9]", "[A-Z]", "[a-z]"))
    return bool(digit and (upper or lower) and (len(part) >= 16 or (upper and lower)))


def is_harmless(value: str, numbers_count: bool) -> bool:
    """Empty, a yes or no, a variable, a plain path, or a number where numbers don't count as secrets."""
    path = re.fullmatch(r"(?:/|~/|\./|\.\./)([A-Za-z0-9._/-]*)", value)
    number = re.fullmatch(r"-?(?=[0-9.]*[0-9])[0-9]*\.?[0-9]*", value)
    return not value or value.lower() in fixed.BOOLEANS or is_reference(value) or bool(number and not numbers_count) or bool(path and not any(map(_generated, path[1].split("/"))))


def _assignment(m: re.Match) -> bool:
    value = plain_value(m["secret"])
    return not set(value) & set("=&,;") and (_last(m["name"]) in fixed.QUALIFIERS or not mentions_secret(m["name"]) or is_harmless(value, ends_with_secret(m["name"])))


def _flag(m: re.Match) -> bool:
    value, words = plain_value(m["secret"]), words_of(m["name"])
    named = words[:1] != ["no"] and (ends_with_secret(m["name"]) or _last(m["name"]) in ("auth", "cookie"))
    return not set(value) & set("=&,;") and (not named or is_harmless(value, True))


def _variable(m: re.Match) -> bool:
    return is_reference(plain_value(m["secret"]))


def _digest(m: re.Match) -> bool:
    return not set(words_of(m["name"])).isdisjoint(fixed.HASH_WORDS) or not re.search("[0-9]", m["secret"]) or not re.search("[A-Fa-f]", m["secret"])


def _remote(m: re.Match) -> bool:
    return m["user"] == "git" and m["remote"] is not None


# (marker, pattern with the group `secret`, whether a match is harmless), in the order in which they apply.
RULES: tuple[tuple[str, re.Pattern, Callable[[re.Match], bool]], ...] = tuple(
    (name, re.compile(pattern), harmless)
    for name, pattern, harmless in (
        ("cookie", r"""(?i)(?a:\b)(?:set-)?cookie["']?\s*:\s*(?P<secret>[^\s"'](?:[^\r\n"']*[^\s"'])?)""", _variable),
        ("assignment", rf"""(?i)(?<![a-z0-9_.-])(?P<name>(?=[a-z0-9_.-]*?(?:{KEYWORDS}))[a-z0-9_.-]++)["']?\s*[=:]\s*(?P<secret>{VALUE}|[^\s"'=:][^\s"']*)""", _assignment),
        ("flag", rf"""(?i)(?:^|[\s"'])(?P<name>--?[a-z0-9_.-]*?(?:{FLAGS}))(?:=|\s+)(?P<secret>{VALUE}|[^\s"'-][^\s"']*)""", _flag),
        ("cli-password", r"""(?a:\b)curl(?a:\b)[^\n|;&]*?\s(?:-u|--user)(?:\s+|=)?["']?[^\s:"']*:(?P<secret>[^\s"']+)""", _variable),
        ("cli-password", r"""(?a:\b)(?i:mysql[a-z]*|mariadb[a-z-]*)(?a:\b)[^\n|;&]*?\s-p["']?(?P<secret>[^\s"']+)""", _variable),
        ("cli-password", r"""(?a:\b)sshpass(?:\s+-v)*\s+-p\s*["']?(?P<secret>[^\s"']+)""", _variable),
        ("hex-secret", r"""(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]++)["']?\s*[=:]\s*["']?(?P<secret>[0-9A-Fa-f]{32,})(?a:\b)""", _digest),
        ("email", r"(?<![A-Za-z0-9._%+-])[.%+-]*+(?P<secret>(?P<user>[A-Za-z0-9._%+-]++)@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?a:\b)(?P<remote>[:/])?", _remote),
    )
)
TOKEN = re.compile(rf"[A-Za-z0-9+/=_-]{{{fixed.RANDOM_CHARS},}}")


def looks_random(token: str) -> bool:
    """Long, with letters and digits, and with more than RANDOM_BITS bits a byte."""
    if len(token) < fixed.RANDOM_CHARS or not re.search("[0-9]", token) or not re.search("[A-Za-z]", token):
        return False
    shares = [n / len(token) for n in Counter(token).values()]
    return -sum(p * math.log2(p) for p in shares) > fixed.RANDOM_BITS


def _unrandom(token: str) -> str:
    """A token replaced whole, or, where it is a path, its random parts."""
    parts = token.split("/")
    is_path = token[:1] in ("/", "~", ".") or (len(parts) > 1 and any(len(p) >= fixed.PATH_WORD_CHARS and p.isascii() and p.isalpha() and p.islower() for p in parts))
    if not is_path:
        return f"{MARK}high-entropy]" if looks_random(token) else token
    for n, part in enumerate(parts):
        if looks_random(part):
            before, after = "/".join([*parts[:n], ""]) if n else "", "/".join(["", *parts[n + 1 :]]) if n + 1 < len(parts) else ""
            return f"{_unrandom(before)}{MARK}high-entropy]{_unrandom(after)}"
    return token


KNOWN = tuple((name, re.compile(p), rf"\1[REDACTED:{name}]{fixed.AFTER_SECRET.get(name, '')}") for name, p in fixed.SECRETS)
# the same as the pattern for passwords in addresses, from the mark on: runs before it are looked at once
ADDRESS = re.compile(r"(://[^/\s:@]+:)([^/\s@]+)@")


def _address(m: re.Match) -> str:
    scheme = re.search(r"(?i)(?a:\b)[a-z][a-z0-9+.-]*\Z", m.string[max(0, m.start() - 100) : m.start()])
    return f"{m[1]}{MARK}url-password]@" if scheme else m[0]


def redacted(text: str) -> str:
    """Known forms, then the rules that decide match by match, then random tokens."""
    low = text.lower()
    for name, pattern, to in KNOWN:
        if any(x in (low if name == "auth-header" else text) for x in LITERALS[name]):
            text = ADDRESS.sub(_address, text) if name == "url-password" else pattern.sub(to, text)
    return guarded(text)


def guarded(text: str) -> str:
    """The rules that decide match by match, then random tokens."""
    for name, pattern, harmless in RULES:

        def replaced(m: re.Match, name=name, harmless=harmless) -> str:
            if harmless(m) or m["secret"].startswith(MARK):
                return m[0]
            a, b = m.start("secret") - m.start(), m.end("secret") - m.start()
            return f"{m[0][:a]}{MARK}{name}]{m[0][b:]}"

        text = pattern.sub(replaced, text)
    return TOKEN.sub(lambda m: _unrandom(m[0]), text)


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redacted, na_action="ignore")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it. No Python function may stand in body."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def known_forms(text: Column) -> Column:
    """Tokens, keys and passwords of known form replaced by [REDACTED:name], each pattern behind a test for its literals."""
    for name, pattern in fixed.SECRETS:
        text = let(text, functools.partial(_known_form, name, pattern))
    return text


def _known_form(name: str, pattern: str, text: Column) -> Column:
    seen, may = F.lower(text) if name == "auth-header" else text, F.lit(False)
    for literal in LITERALS[name]:
        may = may | F.contains(seen, F.lit(literal))
    return F.when(may, F.regexp_replace(text, pattern, f"$1[REDACTED:{name}]{fixed.AFTER_SECRET.get(name, '')}")).otherwise(text)


def may_hold_secret(text: Column) -> Column:
    """Whether any rule can match at all."""

    def has(c: Column, words: tuple) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(c, F.lit(w))
        return out

    low = F.lower(text)
    known = has(text, tuple(x for n, own in LITERALS.items() if n != "auth-header" for x in own))
    named = has(low, ("secret", "token", "pass", "key", "credential", "auth", "cookie")) & has(low, ("=", ":", "-"))
    return known | named | has(low, ("@", "curl", "mysql", "mariadb", "sshpass")) | text.rlike(TOKEN.pattern)


def redact_secrets(text: Column) -> Column:
    """All secrets replaced; a null stays null."""
    some = let(text, lambda t: F.when(may_hold_secret(t), t))
    return F.coalesce(F.pandas_udf(_redacted, "string")(some), text)


def fold_home(text: Column, home: str) -> Column:
    """A home directory as ~, where a path starts and ends."""
    home = home.rstrip("/")
    mark = r"""\s"'`=,;()\[\]{}<>|&"""
    begins = rf"(?:^|(?<=[{mark}])|(?<=:)(?<!(?<![\p{{L}}\p{{N}}])[A-Za-z]:))"
    return F.regexp_replace(text, rf"{begins}\Q{home}\E(?=$|[/\\:{mark}])", "~") if len(home) > 1 else text


def contains_secret(text: Column) -> Column:
    return F.coalesce(redact_secrets(text) != text, F.lit(False))
