"""Session analytics over canonical events: tasks, outcomes, steps, phases, nearest events, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import fixed, shell, text
from tracemill.tables import durable


def numbered(events: DataFrame, session: str, *order: str) -> DataFrame:
    """Adds seq, the place of an event in its session."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("bigint"))


def split_tasks(prompts: DataFrame, session: str, seq: str, prompt: str, before: bool = False) -> DataFrame:
    """Adds task: the number of openers so far. The first prompt that isn't a bare follow-up opens; later ones that aren't
    follow-ups. `prompt` is null for events that are no prompts; events before the first task are dropped, or are task 0 if `before`.
    """
    own = Window.partitionBy(session)
    so_far = own.orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    said = F.col(prompt).isNotNull()
    first = F.min(F.when(said & ~text.bare_follow_up(F.col(prompt)), F.col(seq))).over(own)
    opens = said & ((F.col(seq) == F.col("__first")) | (F.col(seq) > F.col("__first")) & ~text.follow_up(F.col(prompt)))
    rows = prompts.withColumn("__first", first).withColumn("task", F.coalesce(F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(so_far), F.lit(0))).drop("__first")
    return rows if before else rows.where("task > 0")


def closed_tasks(tasks: DataFrame, session: str, ended: Column) -> DataFrame:
    """All tasks of ended sessions, all but the last of others."""
    return tasks.withColumn("__last", F.max("task").over(Window.partitionBy(session))).where(ended | (F.col("task") < F.col("__last"))).drop("__last")


def outcomes(calls: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """outcome per task from calls with columns kind (edit, check, other), ok and hides.

    Judged after the last successful edit: the last visible check, and every failed one by a later pass.
    """
    w = Window.partitionBy(*keys)
    edit = F.max(F.when((F.col("kind") == "edit") & F.col("ok"), F.col(seq))).over(w)
    after = calls.withColumn("__edit", edit)
    is_check = (F.col("kind") == "check") & (F.col(seq) > F.col("__edit"))
    seen, hidden = is_check & ~F.col("hides"), is_check & F.col("hides")
    return (
        after.groupBy(*keys)
        .agg(
            F.max("__edit").alias("__edit"),
            F.max_by(F.col("ok"), F.when(seen, F.col(seq))).alias("__last"),
            F.max(F.when(seen, F.col(seq))).alias("__at"),
            F.count_if(hidden).alias("__hidden"),
        )
        .select(
            *keys,
            F.when(F.col("__edit").isNull(), "unjudged").when(F.col("__at").isNotNull(), F.when(F.col("__last"), "succeeded").otherwise("failed")).when(F.col("__hidden") > 0, "unjudged").otherwise("failed").alias("outcome"),
        )
    )


def uncovered_failures(checks: DataFrame, session: str, program: str, seq: str, ok: str) -> DataFrame:
    """Failed checks that no later pass of the same program covers (anti-join by a window maximum)."""
    last = F.max(F.when(F.col(ok), F.col(seq))).over(Window.partitionBy(session, program))
    return checks.withColumn("__pass", F.coalesce(last, F.lit(-1))).where(~F.col(ok) & (F.col("__pass") < F.col(seq))).drop("__pass")


def first_seen(calls: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Distinct rows by keys with the place of the first, for steps that count once."""
    return calls.groupBy(*keys).agg(F.min(seq).alias("first_seq"), F.count("*").alias("times"))


def work_phases(calls: DataFrame, session: str, seq: str, is_run: Column) -> DataFrame:
    """Adds phase: runs so far. Edits of a file count once within a phase."""
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("phase", F.sum(is_run.cast("int")).over(w))


def avoid_pairs(calls: DataFrame, session: str, seq: str, failed: Column, edit: Column, passed: Column) -> DataFrame:
    """Failures with the first pass after them, where no edit lies between."""
    later = Window.partitionBy(session).orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
    out = calls.withColumn("next_edit", F.min(F.when(edit, F.col(seq))).over(later)).withColumn("next_pass", F.min(F.when(passed, F.col(seq))).over(later))
    return out.where(failed & F.col("next_pass").isNotNull() & (F.col("next_edit").isNull() | (F.col("next_pass") < F.col("next_edit"))))


def nearest(left: DataFrame, right: DataFrame, session: str, at: str, other_at: str, other_seq: str, most_seconds: int) -> DataFrame:
    """For each row of left the seq of the nearest row of right by time, within a bound; ties go to the smaller seq.

    The bound makes it an equi-join on coarse time buckets (each right row is in three), so one busy session is spread over its buckets.
    Repeated rows of left are looked up once and come back as often as they were.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (most_seconds * 1_000_000))
    l = left.withColumn("__b", bucket(at)).withColumn("__row", F.struct(*left.columns)).groupBy("__row", session, at, "__b").agg(F.count("*").alias("__times"))
    r = right.select(F.col(session), F.col(other_at).alias("__at"), F.col(other_seq).alias("__seq"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(other_at) + d)).alias("__b"))
    gap = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__at").cast("timestamp")))
    found = l.join(r, [session, "__b"]).withColumn("__gap", gap).where(F.col("__gap") <= most_seconds * 1_000_000)
    best = found.groupBy("__row").agg(F.min(F.struct("__gap", "__seq")).alias("m"), F.first("__times").alias("n"))
    return best.select("__row", "m", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select("__row.*", F.col("m.__seq").alias("near_seq"), F.col("m.__gap").alias("gap_us"))


def as_of(events: DataFrame, session: str, order: list[str], is_left: Column, is_right: Column, value: str, name: str) -> DataFrame:
    """For each left event the value of the last right event before it: one window instead of a join."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(is_right, F.col(value)), ignorenulls=True).over(w)).where(is_left)


def idle_sessions(events: DataFrame, key: str, at: str, seconds: int = fixed.IDLE_SECONDS) -> DataFrame:
    """Sessions that end after so many idle seconds: key, started, ended, events."""
    order = Window.partitionBy(key).orderBy(at)
    seen = F.unix_micros(F.col(at).cast("timestamp"))
    out = events.withColumn("__gap", seen - F.lag(seen).over(order))
    out = out.withColumn("__n", F.sum((F.col("__gap").isNull() | (F.col("__gap") > seconds * 1_000_000)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(key, F.col("__n").alias("session_no")).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"))


def last_write_wins(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each id, at the place of its first."""
    place = F.struct(*order)
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), place).alias("r"), F.min(place).alias("p")).select(key, "r.*", F.col(f"p.{order[0]}").alias("first_place"))


def live_chain(records: DataFrame, log: str, key: str, parent: str, place: str) -> DataFrame:
    """(log, key): the records on the parent chain of each log's last record. Only keys move, and pointers double in each round.

    A record's ancestors are found by joining the pointers with themselves, so a chain of n records takes log2(n) rounds; a parent
    that isn't in the log ends the chain, and so does one met before (a circle).
    """
    own = records.groupBy(log, key).agg(F.min_by(parent, place).alias("up"), F.max(place).alias("at"))
    known = own.select(log, F.col(key).alias("up"), F.lit(True).alias("known"))
    jump = durable(own.join(known, [log, "up"], "left").select(log, key, F.when(F.col("known"), F.col("up")).alias("up"), "at"), "chain")
    live = jump.groupBy(log).agg(F.max_by(key, "at").alias(key))
    while True:
        more = live.join(jump.where("up IS NOT NULL").select(log, key, "up"), [log, key]).select(log, F.col("up").alias(key))
        grown = durable(live.unionByName(more).distinct(), "live")
        if grown.count() == live.count():
            return grown
        live = grown
        step = jump.select(log, F.col(key).alias("up"), F.col("up").alias("next"))
        jump = durable(jump.join(step, [log, "up"], "left").select(log, key, F.col("next").alias("up"), "at"), "chain")


def after_rewinds(log: DataFrame, session: str, seq: str, target: str) -> DataFrame:
    """Records that no later rewind takes back. A rewind at seq s to target t takes back those in [t, s)."""
    later = Window.partitionBy(session).orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
    return log.withColumn("__t", F.min(target).over(later)).where(F.col(target).isNull() & (F.col("__t").isNull() | (F.col(seq) < F.col("__t")))).drop("__t")


def analyzed_calls(calls: DataFrame) -> DataFrame:
    """Adds c, the analysis of the commands of run calls, and the flags edit, hides and lint (why a command may not be repeated)."""
    command = F.when(F.col("action") == "run", F.col("command"))
    out = calls.withColumn("c", shell.analysis(command))
    refused = F.when(F.contains(command, F.lit("[REDACTED:")), "secret").otherwise(text.danger(command))
    return (
        out.withColumn("edit", F.coalesce((F.col("action") == "edit") & F.col("ok") & (F.col("changes") > 0), F.lit(False)))
        .withColumn("hides", F.coalesce(F.col("ok") & ~F.col("confirmed") & F.col("c.hides_status"), F.lit(False)))
        .withColumn("lint", refused)
    )


def judged(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per task: outcome, why, and verified_at, the seq of the check that decides.

    calls: from analyzed_calls, by keys and seq, with ok, declared (the command is a declared check) and strongest (it is the strongest
    one). Interrupted calls are left out before. After the last edit, the last check that shows its status must pass, each failed one must be answered by a
    later pass that covers it, and the last run of the strongest declared check must pass. A task of the project that failed
    before and passes after the last edit with the same command is a check too.
    """
    own = Window.partitionBy(*keys)
    at = lambda cond: F.max(F.when(cond, F.col("seq")))
    rows = calls.withColumn("__edit", at(F.col("edit")).over(own))
    after = F.col("seq") > F.col("__edit")
    same = Window.partitionBy(*keys, "command")
    learned = at(~F.col("ok") & F.col("c.is_task") & ~after).over(same).isNotNull() & at(F.col("ok") & after).over(same).isNotNull()
    checks = F.coalesce(after & (F.col("c.is_check") | learned | F.col("declared")), F.lit(False))
    rows = rows.withColumn("__check", checks).withColumn("__seen", F.col("__check") & ~F.col("hides"))
    passed = F.col("__seen") & F.col("ok")
    tests, program = at(passed & F.col("c.runs_tests")).over(own), at(passed).over(Window.partitionBy(*keys, "c.clean_program"))
    answered = F.coalesce(F.when(F.col("c.runs_tests"), tests).otherwise(program), F.lit(-1)) > F.col("seq")
    rows = rows.withColumn("__open", F.col("__seen") & ~F.col("ok") & ~answered)
    main = F.col("strongest") & after
    tasks = rows.groupBy(*keys).agg(
        F.max("__edit").alias("__edit"), at(F.col("__seen")).alias("verified_at"), F.max_by("ok", F.when(F.col("__seen"), F.col("seq"))).alias("__last"),
        F.bool_or("__open").alias("__open"), F.bool_or("__check").alias("__any"), F.max_by("ok", F.when(main, F.col("seq"))).alias("__main"),
    )
    why = (
        F.when(F.col("__edit").isNull(), "no edits")
        .when(F.col("verified_at").isNull(), F.when(F.col("__any"), "status hidden").otherwise("not verified"))
        .when(~F.col("__last") | F.col("__open") | ~F.coalesce("__main", F.lit(True)), "verification failed")
    )
    outcome = F.when(why.isNull(), "succeeded").when(why.isin("no edits", "status hidden"), "unjudged").otherwise("failed")
    return tasks.select(*keys, outcome.alias("outcome"), why.alias("why"), F.when(why.isNull(), F.col("verified_at")).alias("verified_at"))


def setup_steps(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, command): distinct successful installations, at their first place."""
    return calls.where("ok AND c.is_setup").groupBy(*keys, "command").agg(F.min("seq").alias("seq"))


def work_steps(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, at, kind, command, target, symbols): edits and runs of project tasks before the deciding check, in order.

    calls: from analyzed_calls, with verified_at and edits: array<struct<path, created, symbols>>. A file counts once between two
    runs, with all its symbols; a run right after the same run counts once.
    """
    before = calls.where(F.col("seq") < F.col("verified_at"))
    edits = before.where("edit").select(*keys, "seq", F.posexplode("edits").alias("at", "e"), F.lit(None).cast("string").alias("command"))
    runs = before.where("NOT edit AND ok AND c.is_task").select(*keys, "seq", F.lit(0).alias("at"), F.lit(None).cast(edits.schema["e"].dataType).alias("e"), "command")
    w = Window.partitionBy(*keys).orderBy("seq", "at")
    items = edits.unionByName(runs).withColumn("__phase", F.sum(F.col("command").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    items = items.withColumn("__again", F.coalesce(F.lag("command").over(w) == F.col("command"), F.lit(False)))
    ran = items.where("command IS NOT NULL AND NOT __again").select(*keys, "seq", "at", F.lit("run").alias("kind"), "command", F.lit(None).cast("string").alias("target"), F.array().cast("array<string>").alias("symbols"))
    place = F.struct("seq", "at")
    made = items.where("e IS NOT NULL").groupBy(*keys, "__phase", F.col("e.path").alias("target")).agg(
        F.min(place).alias("p"), F.min_by("e.created", place).alias("new"), F.array_sort(F.collect_list(F.struct("seq", "at", F.col("e.symbols").alias("s")))).alias("l")
    )
    symbols = F.array_distinct(F.flatten(F.transform("l", lambda x: x["s"])))
    made = made.select(*keys, "p.seq", "p.at", F.when(F.col("new"), "create").otherwise("edit").alias("kind"), F.lit(None).cast("string").alias("command"), "target", symbols.alias("symbols"))
    return made.unionByName(ran)


def refused_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, why): the first reason in step order why a task's steps may not be kept: too many, outside the project, a secret, a danger."""
    said = lambda c: F.when(F.contains(c, F.lit("[REDACTED:")), "secret").otherwise(text.danger(c))
    outside = F.when(F.col("kind").isin("edit", "create") & text.outside_project(F.col("target")), "outside project")
    rows = steps.withColumn("__why", F.coalesce(outside, said(F.col("command")), said(F.col("target"))))
    out = rows.groupBy(*keys).agg(F.min_by("__why", F.when(F.col("__why").isNotNull(), F.struct("seq", "at"))).alias("first"), F.count("*").alias("n"))
    return out.select(*keys, F.when(F.col("n") > fixed.MOST_STEPS, "too many steps").otherwise(F.col("first")).alias("why")).where("why IS NOT NULL")


def avoid_lines(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, line): the first MOST_AVOID failed commands of a task with what worked in their place.

    calls: from analyzed_calls, with exit_code. A command that was not found is answered by a later success of the same tool with the same arguments elsewhere; a check by
    a later one that covers it, before the next edit. Commands that succeed later as they are, and refused ones, give no line.
    """
    later = Window.partitionBy(*keys).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    of = lambda *more: Window.partitionBy(*keys, *more).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    fine = F.col("ok") & ~F.col("hides") & F.col("command").isNotNull() & F.col("lint").isNull() & (F.col("action") == "run")
    found = lambda cond, w: F.min(F.when(cond, F.struct("seq", "command"))).over(w)
    rows = (
        calls.withColumn("__again", F.max(F.when(F.col("ok"), F.col("seq"))).over(of("command")))
        .withColumn("__edit", F.min(F.when(F.col("edit"), F.col("seq"))).over(later))
        .withColumn("__tool", found(fine, of("c.tool")))
        .withColumn("__tests", found(fine & F.col("c.is_check") & F.col("c.runs_tests"), later))
        .withColumn("__program", found(fine & F.col("c.is_check"), of("c.clean_program")))
    )
    missing = F.coalesce(F.col("exit_code") == fixed.NOT_FOUND, F.lit(False))
    covering = F.when(F.col("c.is_check"), F.when(F.col("c.runs_tests"), F.col("__tests")).otherwise(F.col("__program")))
    covering = F.when(F.col("__edit").isNull() | (covering["seq"] < F.col("__edit")), covering)
    other = F.when(missing, F.when(F.col("c.tool").isNotNull(), F.col("__tool"))).otherwise(covering)
    code = F.coalesce(F.concat(F.lit(" (exit "), F.col("exit_code").cast("string"), F.lit(")")), F.lit(""))
    line = F.concat(F.lit("`"), "command", F.lit("` failed"), code, F.lit("; `"), other["command"], F.lit("` worked"))
    out = rows.where(~F.col("ok") & (F.col("action") == "run") & F.col("command").isNotNull() & F.col("lint").isNull() & F.col("__again").isNull()).select(*keys, "seq", line.alias("line")).where("line IS NOT NULL")
    return out.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where(F.col("__n") <= fixed.MOST_AVOID).drop("__n")


def title(summary):
    """The first sentence of a prompt, TITLE_CHARS characters at most."""
    first = F.regexp_replace(text.trimmed(F.substring_index(summary, ". ", 1)), r"\.+$", "")
    return F.when(F.length(first) <= fixed.TITLE_CHARS, first).otherwise(F.concat(F.regexp_replace(F.substring(first, 1, fixed.TITLE_CHARS - 3), r"\s+$", ""), F.lit("...")))
