"""The store as facts: what is written is appended, and what holds is a grouped aggregate or a window over the facts.

A fact carries the time at which it was said; facts are folded in the order of that time (of equal times by all their columns), not of their arrival. So
batches may come twice, late or in any order, and a job that is run again changes nothing. Conditional writes are rules of
the fold: the first extraction of a task counts, a learned decision changes serving revisions only (so one made before a retirement comes too late), and
what was forgotten stays so until it is said anew.

Facts by table:
    extractions (session, first_seq, summary, procedure, revision, rejection, outcome, tool_calls, started_at, ended_at, at)
    revisions   (procedure, revision, family, repo, title, state, at)              a revision as learned; its first state
    injections  (injection, session, procedure, revision, holdout, cue, at)        injection: an id that the writer makes
    settlements (injection, task, outcome, at)
    reminders   (injection, at)
    states      (procedure, revision, state, learned, at)                          learned: decided from evidence or age, not set by a user
    progress    (session, harness, transcript, repo, extracted_through, ended, at)
    forgotten   (what, value, at)                                                  what: procedure, repo, session or all
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators import learning, policy
from tracemill.tables import durable

SERVING = ("active", "stale", "candidate")

SCHEMAS = {
    "extractions": "session string, first_seq long, summary string, procedure string, revision int, rejection string, outcome string, tool_calls long, started_at timestamp, ended_at timestamp, at timestamp",
    "revisions": "procedure string, revision int, family string, repo string, title string, state string, at timestamp",
    "injections": "injection string, session string, procedure string, revision int, holdout boolean, cue string, at timestamp",
    "settlements": "injection string, task long, outcome string, at timestamp",
    "reminders": "injection string, at timestamp",
    "states": "procedure string, revision int, state string, learned boolean, at timestamp",
    "progress": "session string, harness string, transcript string, repo string, extracted_through long, ended boolean, at timestamp",
    "forgotten": "what string, value string, at timestamp",
}


def _place(facts: DataFrame) -> Column:
    return F.struct("at", *(c for c in facts.columns if c != "at"))


def first_of(facts: DataFrame, *keys: str) -> DataFrame:
    """The first fact of each key."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), _place(facts)).alias("r")).select(*keys, "r.*")


def last_of(facts: DataFrame, *keys: str) -> DataFrame:
    """The last fact of each key."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), _place(facts)).alias("r")).select(*keys, "r.*")


def accepted(states: DataFrame, revisions: DataFrame) -> DataFrame:
    """State facts with accepted: whether each was in force when it came. Facts about revisions that aren't there are left out.

    A state that a user sets always counts. A learned one counts while the revision serves: from the last set state (the revision's first one) on, up to and with the first that
    ends serving.
    """
    first = revisions.groupBy("procedure", "revision").agg(F.min_by("state", _place(revisions)).alias("__first"), F.min("at").alias("__from"))
    rows = states.join(first, ["procedure", "revision"]).where("at >= __from")
    order = F.col("at"), F.col("learned"), F.col("state")
    own = Window.partitionBy("procedure", "revision").orderBy(*order)
    rows = rows.withColumn("__set", F.sum((~F.col("learned")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("procedure", "revision", "__set").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.bool_or(~F.col("state").isin(*SERVING)).over(before), F.lit(False)) | ((F.col("__set") == 0) & ~F.col("__first").isin(*SERVING))
    return rows.withColumn("accepted", ~F.col("learned") | ~ended).drop("__set", "__first", "__from")


def current_states(states: DataFrame, revisions: DataFrame) -> DataFrame:
    """Revisions with the state that holds."""
    place = F.struct("at", "learned", "state")
    now = accepted(states, revisions).where("accepted").groupBy("procedure", "revision").agg(F.max_by("state", place).alias("__state"))
    return last_of(revisions, "procedure", "revision").join(now, ["procedure", "revision"], "left").withColumn("state", F.coalesce("__state", "state")).drop("__state")


def settled_injections(injections: DataFrame, settlements: DataFrame, reminders: DataFrame) -> DataFrame:
    """Injections with the task and outcome last settled, and reminded_at; an injection that is said again counts once."""
    done = last_of(settlements, "injection").select("injection", "task", "outcome")
    told = reminders.groupBy("injection").agg(F.max("at").alias("reminded_at"))
    return first_of(injections, "injection").join(done, "injection", "left").join(told, "injection", "left")


def outcome_totals(settled: DataFrame) -> DataFrame:
    """Per revision: successes, failures, injections, holdouts and last_success_at. Withheld ones count apart, unjudged ones only as injections."""
    shown = ~F.col("holdout")
    won = shown & (F.col("outcome") == "succeeded")
    return settled.groupBy("procedure", "revision").agg(
        F.count_if(won).alias("successes"), F.count_if(shown & (F.col("outcome") == "failed")).alias("failures"), F.count_if(shown).alias("injections"), F.count_if("holdout").alias("holdouts"), F.max(F.when(won, F.col("at"))).alias("last_success_at")
    )


def usage(revisions: DataFrame, settled: DataFrame) -> DataFrame:
    """Serving revisions with used_at: when a settled injection last showed them, else when they were last learned."""
    used = settled.where("outcome IS NOT NULL").groupBy("procedure", "revision").agg(F.max("at").alias("__used"))
    return revisions.where(F.col("state").isin(*SERVING)).join(used, ["procedure", "revision"], "left").select("procedure", "revision", "state", F.coalesce("__used", "at").alias("used_at"))


def evidence(revisions: DataFrame, settled: DataFrame) -> DataFrame:
    """Per revision: state, s and f of its own, and hs and hf of all withheld ones of its procedure."""
    judged = settled.where(F.col("outcome").isin("succeeded", "failed"))
    own = judged.where("NOT holdout").groupBy("procedure", "revision").agg(F.count_if(F.col("outcome") == "succeeded").alias("s"), F.count_if(F.col("outcome") == "failed").alias("f"))
    held = judged.where("holdout").groupBy("procedure").agg(F.count_if(F.col("outcome") == "succeeded").alias("hs"), F.count_if(F.col("outcome") == "failed").alias("hf"))
    rows = revisions.select("procedure", "revision", "state", F.col("at").alias("learned_at")).join(own, ["procedure", "revision"], "left").join(held, "procedure", "left")
    return rows.fillna(0, ["s", "f", "hs", "hf"])


def decisions(revisions: DataFrame, settled: DataFrame, now: Column) -> DataFrame:
    """State facts that age and then evidence decide at a time, for revisions whose state changes; as facts, they are learned."""
    old = usage(revisions, settled).withColumn("__aged", learning.aged(F.col("state"), F.datediff(now, F.col("used_at")))).select("procedure", "revision", "__aged")
    rows = evidence(revisions, settled).join(old, ["procedure", "revision"], "left").withColumn("__was", F.col("state")).withColumn("state", F.coalesce("__aged", "state"))
    out = policy.settled(rows, "procedure").where("next_state <> __was")
    return out.select("procedure", "revision", F.col("next_state").alias("state"), F.lit(True).alias("learned"), now.cast("timestamp").alias("at"))


def forgotten_procedures(forgotten: DataFrame, revisions: DataFrame) -> DataFrame:
    """(procedure, gone): when each procedure was last forgotten, by itself, with its repository or with everything."""
    one = forgotten.where("what = 'procedure'").select(F.col("value").alias("procedure"), F.col("at").alias("gone"))
    last = forgotten.where("what = 'repo'").groupBy(F.col("value").alias("repo")).agg(F.max("at").alias("gone"))
    repo = revisions.select("procedure", "repo", "at").join(last, "repo").where("at <= gone").select("procedure", "gone")
    return one.unionByName(repo).groupBy("procedure").agg(F.max("gone").alias("gone"))


def forgotten_all(forgotten: DataFrame) -> Column | None:
    """When everything was last forgotten; one value."""
    at = forgotten.where("what = 'all'").agg(F.max("at").alias("at")).first()["at"]
    return None if at is None else F.lit(at)


def remembered(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without what was forgotten: facts up to the time at which their procedure, its repository, their session or everything was.

    Extractions go with the procedure learned from them; settlements and reminders with their injection.
    """
    forgotten, revisions = tables["forgotten"], tables["revisions"]
    gone = durable(forgotten_procedures(forgotten, revisions), "forgotten")
    sessions = forgotten.where("what = 'session'").groupBy(F.col("value").alias("session")).agg(F.max("at").alias("gone"))
    everything = forgotten_all(forgotten)
    out = dict(tables)
    for name in ("extractions", "revisions", "injections", "states"):
        rows = tables[name].join(gone, "procedure", "left")
        out[name] = rows.where("gone IS NULL OR at > gone").drop("gone").select(*tables[name].columns)
    rows = tables["progress"].join(sessions, "session", "left")
    out["progress"] = rows.where("gone IS NULL OR at > gone").drop("gone").select(*tables["progress"].columns)
    if everything is not None:
        for name in ("extractions", "revisions", "injections", "states", "progress"):
            out[name] = out[name].where(F.col("at") > everything)
    for name in ("settlements", "reminders"):
        out[name] = tables[name].join(out["injections"].select("injection").distinct(), "injection", "left_semi")
    return out


def current_progress(progress: DataFrame) -> DataFrame:
    """Per session the last progress said. The harness is that of the first; an end that only says so (other columns null) keeps the rest."""
    place = _place(progress)
    said = F.col("transcript").isNotNull()
    last = lambda c: F.max_by(c, F.when(said, place)).alias(c)
    rows = progress.groupBy("session").agg(F.min_by("harness", F.when(said, place)).alias("harness"), last("transcript"), last("repo"), last("extracted_through"), F.max_by("ended", place).alias("ended"), F.max("at").alias("updated_at"))
    return rows.where("transcript IS NOT NULL")


def open_sessions(progress: DataFrame, harness: str | None = None) -> DataFrame:
    """Sessions of current_progress that haven't ended, the longest unchanged first."""
    rows = progress.where("NOT ended")
    return (rows if harness is None else rows.where(F.col("harness") == harness)).orderBy("updated_at", "session")


def rejections(extractions: DataFrame, limit: int) -> DataFrame:
    """The latest extractions that became no procedure."""
    return first_of(extractions, "session", "first_seq").where("rejection IS NOT NULL").orderBy(F.desc("at"), "session", "first_seq").limit(limit)


def retirement(revisions: DataFrame, procedure: str, now: Column) -> DataFrame:
    """State facts that retire all revisions of a procedure."""
    rows = revisions.where(F.col("procedure") == procedure).select("procedure", "revision").distinct()
    return rows.select("procedure", "revision", F.lit("retired").alias("state"), F.lit(False).alias("learned"), now.cast("timestamp").alias("at"))


class Store:
    """Fact tables in a folder. A batch of facts is written once under its own name; one that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, table: str, facts: DataFrame, batch: str) -> None:
        """Adds a batch of facts; whole or not at all, and once however often it is tried."""
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        facts.select(*names).to(self.spark.createDataFrame([], SCHEMAS[table]).schema).write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def read(self, table: str, without: str | None = None, until: Column | None = None) -> DataFrame:
        """All facts of a table; if asked, without those of one batch, or only those said up to a time."""
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return empty
        rows = self.spark.read.schema(f"{SCHEMAS[table]}, batch string").parquet(f"{self.path}/{table}")
        rows = rows if without is None else rows.where(F.col("batch") != without)
        return (rows if until is None else rows.where(F.col("at") <= until)).select(*empty.columns)

    def tables(self, without: dict[str, str] | None = None, until: Column | None = None) -> dict[str, DataFrame]:
        """What is remembered of each table."""
        return remembered({name: self.read(name, (without or {}).get(name), until) for name in SCHEMAS})

    def settle(self, settlements: DataFrame, now: Column, batch: str) -> DataFrame:
        """Writes settlements, then what they and age decide for all procedures; the decisions that were accepted.

        Decisions rest on facts up to now and not on this batch's own, so that a run that is tried again decides the same.
        """
        self.append("settlements", settlements, batch)
        t = self.tables({"states": batch}, now)
        settled = settled_injections(t["injections"], t["settlements"], t["reminders"])
        decided = durable(decisions(current_states(t["states"], t["revisions"]), settled, now), "decided")
        self.append("states", decided, batch)
        t = self.tables()
        return accepted(t["states"], t["revisions"]).where("accepted").join(decided.select("procedure", "revision", "state", "at"), ["procedure", "revision", "state", "at"], "left_semi")
