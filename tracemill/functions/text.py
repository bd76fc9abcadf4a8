"""Text functions as Column expressions, so that they stay in generated code."""

from __future__ import annotations

import functools
import operator
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import fixed, redaction
from tracemill.functions.redaction import let


def folded(text: Column) -> Column:
    """Latin letters without their diacritic, in lower case. Other scripts keep theirs."""
    plain = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}
    pairs = [(c, base) for base, marked in plain.items() for c in marked]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return F.translate(F.lower(text), "".join(c for c, _ in pairs) + marks, "".join(b for _, b in pairs))


TERM = r"[\p{L}\p{N}](?:[\p{L}\p{N}_\-./]*[\p{L}\p{N}])?"


def terms(text: Column) -> Column:
    """Search terms in order: letters, digits and _ - . / within a term (not at its ends), stop words left out."""
    return F.filter(F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0)), lambda w: ~w.isin(*fixed.STOP_WORDS))


def query_terms(text: Column) -> Column:
    return F.slice(F.array_distinct(terms(text)), 1, fixed.TERM_LIMIT)


def phrases(text: Column) -> Column:
    """Distinct runs of two and three terms by where they start, at most TERM_LIMIT."""

    def runs(t: Column) -> Column:
        run = lambda i, n: F.when(i + (n - 1) <= F.size(t), F.array_join(F.slice(t, i, n), " "))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.array(run(i, 2), run(i, 3)))
        return F.filter(F.flatten(grams), lambda x: x.isNotNull())

    return F.slice(F.array_distinct(let(terms(text), runs)), 1, fixed.TERM_LIMIT)


def prompt_keys(text: Column) -> Column:
    """Keys by which a prompt is looked up: terms, names and stems of those that are paths, phrases, errors pasted in."""

    def terms_and_names(t: Column) -> Column:
        name = F.transform(F.filter(t, lambda w: F.contains(w, F.lit("/"))), lambda w: F.element_at(F.split(w, "/"), -1))
        stems = lambda n: F.filter(F.transform(F.filter(n, lambda w: F.contains(w, F.lit("."))), lambda w: F.substring_index(w, ".", 1)), lambda w: F.length(w) > 2)
        return F.concat(t, let(name, lambda n: F.concat(n, stems(n))))

    return F.array_sort(F.array_distinct(F.concat(let(query_terms(text), terms_and_names), phrases(text), pasted_errors(text))))


def skeleton(text: Column) -> Column:
    """The text with each closed quotation (backticks, double and curly quotes) as one space."""
    return F.regexp_replace(text, "`[^`]*`|\"[^\"]*\"|“[^”]*”", " ")


def prompt_words(text: Column) -> Column:
    plain = F.lower(F.translate(skeleton(text), "‘’", "''"))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}'\-_]+"), lambda w: w != "")


def task_kind(text: Column) -> Column:
    """fix, add, meta or null; the first rule that holds decides."""
    words, plain = prompt_words(text), F.lower(F.translate(skeleton(text), "‘’", "''"))
    has = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    phrase = F.lit(False)
    for p in fixed.FIX_PHRASES:
        phrase = phrase | F.contains(plain, F.lit(p))
    symptom = has(fixed.FIX_WORDS) | phrase
    return (
        F.when(has(fixed.DOC_WORDS), "meta")
        .when(has(("fix",)), "fix")
        .when(has(fixed.TEST_WORDS) & (has(fixed.WRITE_WORDS) | ~symptom), "meta")
        .when(symptom, "fix")
        .when(has(fixed.ADD_WORDS), "add")
    )


def artifacts(text: Column) -> Column:
    """Sorted distinct classes of things that a text names."""
    classes = lambda kind: F.array(*map(F.lit, (kind,) if isinstance(kind, str) else kind))
    known = F.create_map(*(x for word, kind in fixed.ARTIFACTS.items() for x in (F.lit(word), classes(kind))))
    found = F.filter(F.transform(prompt_words(text), lambda w: known[w]), lambda k: k.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(found)))


def requested_artifact(text: Column) -> Column:
    """Classes of the first thing that a text names; null if it names none."""
    classes = lambda kind: F.array(*map(F.lit, (kind,) if isinstance(kind, str) else kind))
    known = F.create_map(*(x for word, kind in fixed.ARTIFACTS.items() for x in (F.lit(word), classes(kind))))
    return F.try_element_at(F.filter(F.transform(prompt_words(text), lambda w: known[w]), lambda k: k.isNotNull()), F.lit(1))


def _unicode(pattern: str) -> str:
    return pattern.replace("(?i)", "(?iU)", 1)


def follow_up(text: Column) -> Column:
    """Whether a prompt goes on with the task before: acknowledgements, then nothing more or a reference back."""
    return F.coalesce(text.rlike(_unicode(fixed.FOLLOW_UP)), F.lit(False))


def bare_follow_up(text: Column) -> Column:
    """Whether a prompt is nothing but acknowledgements and references back."""
    return F.coalesce(text.rlike(_unicode(fixed.BARE_FOLLOW_UP)), F.lit(False))


ASCII_FORMS = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\s": r"[ \t\n\f\r]", r"\S": r"[^ \t\n\f\r]", ".": r"[^\n]", "$": r"\z"}


def ascii_pattern(pattern: str) -> str:
    """A pattern that means in Java what it means in SQL: letters at word ends and white space are ASCII (without \\v), only \\n ends a line, $ is the very end."""

    def of(found: re.Match) -> str:
        token = found[0]
        return token.replace(r"\s", r" \t\n\f\r") if token.startswith("[") else ASCII_FORMS.get(token, token)

    return re.sub(r"\\.|\[(?:\\.|[^\]\\])+\]|[.$]", of, pattern)


def danger(text: Column) -> Column:
    """Name of the first danger rule that a text matches, or null; a rule is tried behind a test for its literals."""
    out = F
    for (name, pattern), literals in zip(fixed.DANGERS, fixed.DANGER_LITERALS, strict=True):
        seen = functools.reduce(operator.or_, (F.contains(text, F.lit(x)) for x in literals))
        out = out.when(seen & text.rlike(ascii_pattern(pattern)), name)
    return out


def redact_emails(text: Column) -> Column:
    """Addresses replaced, but for git's own at a remote."""
    name, host = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, rf"(?<!{name})([.%+-]*+)(?!git@{host}\b[:/]){name}++@{host}\b", "$1[REDACTED:email]")).otherwise(text)


def redact(text: Column, home: str | None = None) -> Column:
    """All secrets replaced, and a home directory as ~."""
    out = redaction.redact_secrets(text)
    return redaction.fold_home(out, home) if home else out


def lines(text: Column) -> Column:
    """The lines of a text; a last line end opens none."""
    body = F.regexp_replace(text, "\r?\n\\z", "")
    return F.when(F.length(text) > 0, F.split(body, "\r?\n")).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def headline(prompt: Column, skipped: tuple[str, ...], pasted: str | None) -> Column:
    """The first line of a trimmed prompt that stands outside wrappers (tags named in skipped and pasted), else what was pasted first; empty if there is neither."""
    tags = [t.rstrip(">") for t in (*skipped, *([pasted] if pasted else [])) if t.startswith("<")]
    if not tags:
        return trimmed(F.regexp_extract(prompt, r"\A\s*([^\n]*)", 1))
    quoted = "|".join(rf"\Q{t[1:]}\E" for t in tags)
    rest = r"[^\n>]*(?:>|(?=\n)|\z)"
    wrapper = rf"<({quoted}){rest}[\s\S]*?(?:</\1{rest}|\z)"
    line = trimmed(F.regexp_extract(prompt, rf"\A(?:\s*{wrapper})*+\s*([^\n]*)", 2))
    if not pasted:
        return line
    inside = F.regexp_extract_all(prompt, F.lit(rf"\Q{pasted}\E[^\n>]*(?:>|(?=\n))\s*([^\n]*?)\s*(?:</\Q{pasted[1:]}\E|\n|\z)"), F.lit(1))
    return F.when(line != "", line).otherwise(F.coalesce(F.try_element_at(F.filter(F.transform(inside, trimmed), lambda x: x != ""), F.lit(1)), F.lit("")))


def truncated_at(text: Column, chars: int) -> Column:
    """The first characters of a text; a redaction mark that would be cut goes whole."""

    def cut(x: Column) -> Column:
        start = F.length(x["near"]) - F.instr(F.reverse(x["near"]), fixed.REDACTED[::-1]) - len(fixed.REDACTED) + 2
        close = F.position(F.lit("]"), x["text"], start)
        straddles = F.contains(x["near"], F.lit(fixed.REDACTED)) & (start <= chars) & ((close == 0) | (close > chars))
        return F.substr(x["text"], F.lit(1), F.when(straddles, start - 1).otherwise(chars))

    return F.when(F.length(text) > chars, let(F.struct(text.alias("text"), F.substr(text, F.lit(1), F.lit(chars + len(fixed.REDACTED) - 1)).alias("near")), cut)).otherwise(text)


def summary(prompt: Column, dialect: str) -> Column:
    """What a prompt is remembered by: its headline, redacted, SUMMARY_CHARS characters at most; null for what isn't said by a user."""
    skipped, pasted = fixed.PROMPTS[dialect]

    def of(text: Column) -> Column:
        own = F.lit(True)
        for prefix in skipped:
            own = own & ~F.startswith(text, F.lit(prefix))
        return F.when(own, headline(text, skipped, pasted))

    def short(line: Column) -> Column:
        most = fixed.SUMMARY_SOURCE_BYTES
        cut = F.regexp_replace(F.decode(F.substring(F.encode(line, "utf-8"), 1, most), "utf-8"), r"\S+\z", "")
        return F.when(F.octet_length(line) > most, cut).otherwise(line)

    source = let(let(trimmed(prompt), of), short)
    return let(F.regexp_replace(truncated_at(redact(source), fixed.SUMMARY_CHARS), r"\s+\z", ""), lambda x: F.when(x != "", x))


def normalized_error(line: Column) -> Column:
    """An error line without what changes from run to run, 120 characters at most."""
    out = F.lower(line)
    for pattern, to in fixed.VOLATILE:
        out = F.regexp_replace(out, pattern, to)
    return F.rtrim(F.substring(F.trim(out), 1, fixed.ERROR_CHARS))


def _error_message(line: Column) -> Column:
    """What a line says after its location, if that is an error of a kind; else null."""
    before = F.regexp_extract(line, fixed.LOCATION, 0)
    message = F.substr(line, F.length(before) + 1)
    located, column = (F.regexp_extract(line, fixed.LOCATION, n) != "" for n in (1, 2))
    is_error = message.rlike(fixed.KINDED) | (~located & message.rlike(fixed.BARE_KIND)) | column
    return F.when(is_error & ~message.rlike(fixed.NOT_AN_ERROR) & ~message.rlike(fixed.ASSERTION), message)


def _plain_error(line: Column) -> Column:
    return F.when(line.rlike(fixed.PLAIN_ERROR) & ~line.rlike(fixed.ASSERTION), line)


def _harmless(signatures: Column) -> Column:
    """Signatures that give no secret away. All are redacted as one text, a line each."""
    kept = F.filter(signatures, lambda x: ~F.contains(x, F.lit("[redacted:")) & ~x.rlike(fixed.PASSWORD_VALUE))
    again = F.split(redaction.redact_secrets(F.array_join(kept, "\n")), "\n")
    return F.array_intersect(kept, again)


def _said(output: Column) -> Column:
    """The lines of an output that say something, redacted and without colours."""
    plain = F.regexp_replace(redaction.redact_secrets(output), fixed.ANSI, "")
    return F.filter(F.transform(lines(plain), trimmed), lambda x: (x != "") & ~x.startswith("Exit code "))


def error_signature(output: Column) -> Column:
    """Signature of the first line that names an error kind (the last after a traceback), else of a plain error line; null if it would give a secret away."""

    def chosen(said: Column) -> Column:
        kinded = F.filter(F.transform(said, _error_message), lambda x: x.isNotNull())
        end = F.when(F.exists(said, lambda x: x.startswith("Traceback")), -1).otherwise(1)
        line = F.coalesce(F.try_element_at(kinded, end), F.try_element_at(F.filter(said, lambda x: _plain_error(x).isNotNull()), F.lit(1)))
        return F.filter(F.array(normalized_error(line)), lambda x: x.isNotNull())

    return F.try_element_at(_harmless(let(_said(output), chosen)), F.lit(1))


def pasted_errors(prompt: Column) -> Column:
    """Distinct error signatures of the lines of a prompt, MOST_PASTED at most."""
    found = F.filter(F.transform(_said(prompt), lambda x: F.coalesce(_error_message(x), _plain_error(x))), lambda x: x.isNotNull())
    return _harmless(F.slice(F.array_distinct(F.transform(found, normalized_error)), 1, fixed.MOST_PASTED))


def output_verdict(output: Column, builds: Column) -> Column:
    """What a check's output says: failed before passed, else null. A finished build passes where the check builds."""
    plain = F.regexp_replace(output, fixed.ANSI, "")
    java = lambda p: p.replace("(?m)", "(?md)", 1)
    passed = plain.rlike(java(fixed.PASSED_OUTPUT)) | (builds & plain.rlike(java(fixed.BUILT_OUTPUT)))
    return F.when(plain.rlike(java(fixed.FAILED_OUTPUT)), "failed").when(passed, "passed")


def verdict(command: Column, output: Column) -> Column:
    """output_verdict where an analyzed command (see shell.analysis) is a check whose exit code doesn't show."""
    return F.when(command["masked"] & command["output_check"], output_verdict(output, command["builds"]))


def _entropies(texts: pd.Series) -> pd.Series:
    def bits(text: str) -> float | None:
        n = np.bincount(np.frombuffer(text.encode(), np.uint8))
        p = n[n > 0] / max(1, n.sum())
        return float(-(p * np.log2(p)).sum()) if len(p) else None

    return texts.map(bits, na_action="ignore").astype(float)


def byte_entropy(text: Column) -> Column:
    """Shannon entropy of a text's bytes, in bits; null for an empty text. Counted in numpy over Arrow batches."""
    return F.nanvl(F.pandas_udf(_entropies, "double")(text), F.lit(None).cast("double"))


def outside_project(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^(?:[/\\~]|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)"), F.lit(False))


def definition(line: Column) -> Column:
    """The name that a line defines, or null."""
    named = lambda p: F.when(line.rlike(p), F.regexp_extract(line, p, 1))
    return F.coalesce(named(fixed.DEFINITION), named(fixed.CONSTANT), named(fixed.ARROW))


def symbols(changed: Column, original: Column | None = None, starts: Column | None = None) -> Column:
    """Distinct names that changed lines define, then those that enclose each hunk of the original; MOST_SYMBOLS at most."""
    found = F.transform(changed, definition)
    if original is not None:

        def enclosing(old: Column, start: Column) -> Column:
            at = F.greatest(F.least(start, F.size(old)), F.lit(1))
            before = F.slice(old, F.greatest(at - (fixed.LOOKBACK_LINES - 1), F.lit(1)), F.least(at, F.lit(fixed.LOOKBACK_LINES)))
            return F.try_element_at(F.filter(F.transform(before, definition), lambda x: x.isNotNull()), F.lit(-1))

        none = F.array().cast("array<string>")
        found = F.concat(found, let(lines(original), lambda old: F.when(F.size(old) > 0, F.transform(starts, lambda s: enclosing(old, s))).otherwise(none)))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), 1, fixed.MOST_SYMBOLS)


def unified_diff(diff: Column) -> Column:
    """struct(added, removed, starts, changed): counts and texts of changed lines within hunks (all lines if there is no hunk header), and where hunks start in the old file."""

    def parts(every: Column) -> Column:
        first = F.array_position(F.transform(every, lambda x: x.startswith("@@")), True).cast("int")
        body = F.slice(every, F.greatest(first, F.lit(1)), F.greatest(F.size(every), F.lit(1)))
        starts = F.filter(F.transform(every, lambda x: F.regexp_extract(x, r"^@@\s*-(\d+)", 1).try_cast("int")), lambda x: x.isNotNull())
        return F.struct(starts.alias("starts"), F.filter(body, lambda x: x.startswith("+") | x.startswith("-")).alias("changed"))

    signed = lambda d, sign: F.filter(d["changed"], lambda x: x.startswith(sign))
    return let(let(lines(diff), parts), lambda d: _diff(signed(d, "+"), signed(d, "-"), d["starts"], F.transform(d["changed"], lambda x: F.substr(x, F.lit(2)))))


def _diff(added: Column, removed: Column, starts: Column, changed: Column) -> Column:
    return F.struct(F.size(added).alias("added"), F.size(removed).alias("removed"), starts.alias("starts"), changed.alias("changed"))


def created_diff(content: Column) -> Column:
    """The same for a new file: all its lines are added."""
    return let(lines(content), lambda x: _diff(x, F.array(), F.array().cast("array<int>"), x))


def replaced_diff(old: Column, new: Column) -> Column:
    """The same for a text put in another's place: what is left without their common first and last lines."""

    def common(o: Column, n: Column) -> Column:
        same = F.transform(F.arrays_zip(o.alias("x"), n.alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))
        return let(F.array_position(same, False).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(F.size(o)))

    def rest(pair: Column) -> Column:
        """Both without what their starts have in common, the other way round."""
        cut = lambda x, k: F.reverse(F.slice(x, k + 1, F.greatest(F.size(x), F.lit(1))))
        return let(common(pair["o"], pair["n"]), lambda k: F.struct(cut(pair["o"], k).alias("o"), cut(pair["n"], k).alias("n")))

    both = let(let(F.struct(lines(old).alias("o"), lines(new).alias("n")), rest), rest)
    return let(both, lambda p: _diff(p["n"], p["o"], F.array().cast("array<int>"), F.concat(p["o"], p["n"])))


FENCE = r"(?m)^[^\S\n]*```[^\n]*$"


def doc_code(text: Column) -> Column:
    """Commands written as code in a document: lines of fenced and indented blocks and inline spans, in order."""
    parts = F.split(text, FENCE)
    bare = lambda x: F.regexp_replace(trimmed(x), r"^(?:\$ )+", "")
    indented = lambda x: x.startswith("    ") | x.startswith("\t")
    loose = lambda x: F.when(indented(x), F.array(bare(x))).otherwise(F.regexp_extract_all(x, F.lit(r"`([^`\n]+)`"), F.lit(1)))
    own = lambda part, n: F.when(n % 2 == 1, F.transform(F.split(part, "\r?\n"), bare)).otherwise(F.flatten(F.transform(F.split(part, "\r?\n"), loose)))
    return F.filter(F.flatten(F.transform(parts, own)), lambda x: x != "")


def family(repo: Column, targets: Column, check: Column) -> Column:
    """Twelve hex digits that name a family of procedures: repository, sorted targets, check program."""
    return F.substring(F.sha2(F.concat_ws("\n", repo, F.array_join(F.array_sort(F.array_distinct(targets)), "\n"), check), 256), 1, 12)
