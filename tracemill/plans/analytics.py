"""Session and learning queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators import learning, sessions
from tracemill.plans.common import EVENTS, events, registrar, table

query, QUERIES, ORACLE = registrar()
_FOLLOW, _BARE = (p.replace("'", "''") for p in (fixed.FOLLOW_UP, fixed.BARE_FOLLOW_UP))


@query(f"""WITH {EVENTS}, p AS (SELECT session, seq, moment FROM ev WHERE type = 'signup'), i AS (SELECT session, seq, moment FROM ev WHERE type = 'purchase'),
  g AS (SELECT i.session, i.seq, p.seq AS near_seq, CAST(abs(epoch_us(i.moment) - epoch_us(p.moment)) AS BIGINT) AS gap_us FROM i JOIN p USING (session) WHERE abs(epoch_us(i.moment) - epoch_us(p.moment)) <= 7200000000)
  SELECT session, seq, near_seq, gap_us FROM (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY gap_us, near_seq) AS n FROM g) WHERE n = 1""")
def q12_nearest_prompt(spark, d):
    e = events(spark, d)
    cues, prompts = e.where("type = 'purchase'").select("session", "seq", "at"), e.where("type = 'signup'")
    return sessions.nearest(cues, prompts, "session", "at", "at", "seq", 7200).select("session", "seq", "near_seq", "gap_us")


@query(f"""WITH {EVENTS} SELECT session, seq, last_value(CASE WHEN type = 'click' THEN seq END IGNORE NULLS) OVER (PARTITION BY session ORDER BY moment, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edit_seq
  FROM ev QUALIFY type = 'error'""")
def q13_asof_failure(spark, d):
    return sessions.as_of(events(spark, d), "session", ["at", "event_id"], F.col("type") == "error", F.col("type") == "click", "seq", "edit_seq").select("session", "seq", "edit_seq")


@query(f"""WITH {EVENTS}, t AS (SELECT session, seq, type, sum(CASE WHEN type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS task FROM ev)
  SELECT session, CAST(task AS BIGINT) AS task, min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (type = 'view') AS injections FROM t WHERE task > 0 GROUP BY ALL""")
def q14_interval_settle(spark, d):
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = events(spark, d).withColumn("task", F.sum((F.col("type") == "signup").cast("bigint")).over(w)).where("task > 0")
    return t.groupBy("session", "task").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_if(F.col("type") == "view").alias("injections"))


@query(f"""WITH {EVENTS}, c AS (SELECT session, seq, type = 'purchase' AS ok, CAST(json_extract(props, '$.k') AS INT) % 3 AS program FROM ev WHERE type IN ('purchase', 'error'))
  SELECT session, program, seq FROM c WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM c p WHERE p.session = c.session AND p.program = c.program AND p.ok AND p.seq > c.seq)""")
def q16_uncovered_failures(spark, d):
    checks = events(spark, d).where(F.col("type").isin("purchase", "error")).select("session", "seq", (F.col("type") == "purchase").alias("ok"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("program"))
    return sessions.uncovered_failures(checks, "session", "program", "seq", "ok").select("session", "program", "seq")


@query(f"""WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN replace(text, '’', '''') END AS prompt FROM conversations),
  f AS (SELECT *, min(CASE WHEN prompt IS NOT NULL AND NOT regexp_matches(prompt, '{_BARE}') THEN turn END) OVER (PARTITION BY conv_id) AS first FROM p),
  o AS (SELECT *, coalesce(prompt IS NOT NULL AND (turn = first OR turn > first AND NOT regexp_matches(prompt, '{_FOLLOW}')), false) AS opens FROM f),
  t AS (SELECT conv_id, turn, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS task FROM o)
  SELECT conv_id, turn, CAST(task AS BIGINT) AS task FROM t WHERE task > 0""")
def q40_task_split(spark, d):
    rows = table(spark, d, "conversations").withColumn("prompt", F.when(F.col("role") == "user", F.col("text")))
    return sessions.split_tasks(rows, "conv_id", "turn", "prompt").select("conv_id", "turn", "task")


@query(f"""WITH {EVENTS}, t AS (SELECT session, seq, sum(CASE WHEN type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS task FROM ev),
  l AS (SELECT *, max(task) OVER (PARTITION BY session) AS last FROM t WHERE task > 0)
  SELECT session, seq, CAST(task AS BIGINT) AS task FROM l WHERE session % 2 = 0 OR task < last""")
def q41_open_task_filter(spark, d):
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = events(spark, d).withColumn("task", F.sum((F.col("type") == "signup").cast("bigint")).over(w)).where("task > 0").select("session", "seq", "task")
    return sessions.closed_tasks(t, "session", F.col("session") % 2 == 0)


_TASKS = f"""WITH {EVENTS}, t AS (SELECT *, sum(CASE WHEN type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS task FROM ev), c AS (SELECT * FROM t WHERE task > 0),"""


@query(_TASKS + """ e AS (SELECT *, max(CASE WHEN type = 'click' THEN seq END) OVER (PARTITION BY session, task) AS edit FROM c),
  k AS (SELECT session, task, max(edit) AS edit, max_by(type = 'purchase', seq) FILTER (type IN ('purchase', 'error') AND seq > edit AND value <= 90) AS last,
    count(*) FILTER (type IN ('purchase', 'error') AND seq > edit AND value <= 90) AS seen, count(*) FILTER (type IN ('purchase', 'error') AND seq > edit AND value > 90) AS hidden FROM e GROUP BY 1, 2)
  SELECT session, CAST(task AS BIGINT) AS task, CASE WHEN edit IS NULL THEN 'unjudged' WHEN seen > 0 THEN CASE WHEN last THEN 'succeeded' ELSE 'failed' END WHEN hidden > 0 THEN 'unjudged' ELSE 'failed' END AS outcome FROM k""")
def q42_last_check_after_edit(spark, d):
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = events(spark, d).withColumn("task", F.sum((F.col("type") == "signup").cast("bigint")).over(w)).where("task > 0")
    kind = F.when(F.col("type") == "click", "edit").when(F.col("type").isin("purchase", "error"), "check").otherwise("other")
    return sessions.outcomes(t.select("session", "task", "seq", kind.alias("kind"), (F.col("type") != "error").alias("ok"), (F.col("value") > 90).alias("hides")), ["session", "task"])


@query(f"""WITH {EVENTS} SELECT session, CAST(json_extract(props, '$.k') AS INT) % 20 AS command, min(seq) AS first_seq, count(*) AS times FROM ev WHERE type = 'view' GROUP BY ALL""")
def q43_setup_first_seen(spark, d):
    calls = events(spark, d).where("type = 'view'").withColumn("command", F.get_json_object("props", "$.k").cast("int") % 20)
    return sessions.first_seen(calls, ["session", "command"], "seq")


@query(f"""WITH {EVENTS}, p AS (SELECT *, sum(CASE WHEN type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS phase FROM ev)
  SELECT session, CAST(phase AS BIGINT) AS phase, CAST(json_extract(props, '$.k') AS INT) % 10 AS path, min(seq) AS first_seq, count(*) AS times FROM p WHERE type = 'click' GROUP BY ALL""")
def q44_work_phases(spark, d):
    phased = sessions.work_phases(events(spark, d), "session", "seq", F.col("type") == "view").where("type = 'click'").withColumn("path", F.get_json_object("props", "$.k").cast("int") % 10)
    return sessions.first_seen(phased, ["session", "phase", "path"], "seq")


@query(f"""WITH {EVENTS}, n AS (SELECT session, seq, type, min(CASE WHEN type = 'click' THEN seq END) OVER w AS next_edit, min(CASE WHEN type = 'purchase' THEN seq END) OVER w AS next_pass FROM ev
    WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT session, seq, next_pass FROM n WHERE type = 'error' AND next_pass IS NOT NULL AND (next_edit IS NULL OR next_pass < next_edit)""")
def q45_avoid_pairs(spark, d):
    return sessions.avoid_pairs(events(spark, d), "session", "seq", F.col("type") == "error", F.col("type") == "click", F.col("type") == "purchase").select("session", "seq", "next_pass")


@query(f"""WITH {EVENTS} SELECT session, coalesce(max(seq) FILTER (type = 'click'), -1) > coalesce(max(seq) FILTER (type = 'purchase'), -1) AS edited FROM ev GROUP BY 1""")
def q46_edited_since_check(spark, d):
    last = lambda kind: F.coalesce(F.max(F.when(F.col("type") == kind, F.col("seq"))), F.lit(-1))
    return events(spark, d).groupBy("session").agg((last("click") > last("purchase")).alias("edited"))


_EVIDENCE = """WITH e AS (SELECT user_id AS procedure, count(*) FILTER (value <= 70 AND event_type = 'purchase') AS s, count(*) FILTER (value <= 70 AND event_type = 'error') AS f,
  count(*) FILTER (value > 70 AND event_type = 'purchase') AS hs, count(*) FILTER (value > 70 AND event_type = 'error') AS hf FROM events GROUP BY 1)"""
_BETTER = "(SELECT sum(exp(lgamma({c}+i) + lgamma({b}+{d}) - lgamma({c}+i+{b}+{d}) - ln({b}+i) - (lgamma(1+i) + lgamma({b}) - lgamma(1+i+{b})) - (lgamma({c}) + lgamma({d}) - lgamma({c}+{d})))) FROM range(0, CAST({a} AS BIGINT)) r(i))"
_P = "CASE WHEN s > hs THEN 1 - " + _BETTER.format(a="(hs+1)", b="(hf+1)", c="(s+1)", d="(f+1)") + " ELSE " + _BETTER.format(a="(s+1)", b="(f+1)", c="(hs+1)", d="(hf+1)") + " END"
_PH = "CASE WHEN hs > s THEN 1 - " + _BETTER.format(a="(s+1)", b="(f+1)", c="(hs+1)", d="(hf+1)") + " ELSE " + _BETTER.format(a="(hs+1)", b="(hf+1)", c="(s+1)", d="(f+1)") + " END"
_BELOW = "(SELECT sum(exp(lgamma(s+f+2) - lgamma(k+1) - lgamma(s+f+1-k+1) + k*ln(0.5) + (s+f+1-k)*ln(0.5))) FROM range(CAST(s+1 AS BIGINT), CAST(s+f+2 AS BIGINT)) r(k))"


def _evidence(spark, d):
    kind, held = F.col("event_type"), F.col("value") > 70
    return table(spark, d, "events").groupBy(F.col("user_id").alias("procedure")).agg(
        F.count_if(~held & (kind == "purchase")).alias("s"), F.count_if(~held & (kind == "error")).alias("f"), F.count_if(held & (kind == "purchase")).alias("hs"), F.count_if(held & (kind == "error")).alias("hf")
    )




def _columns():
    return tuple(map(F.col, ("s", "f", "hs", "hf")))


@query(_EVIDENCE + " SELECT procedure, round((s + 1) / (s + f + 2), 9) AS mean FROM e")
def q80_beta_mean(spark, d):
    s, f, _, _ = _columns()
    return _evidence(spark, d).select("procedure", F.round(learning.mean(s, f), 9).alias("mean"))


@query(_EVIDENCE + f" SELECT procedure, round({_P}, 6) AS p FROM e")
def q81_prob_better(spark, d):
    return _evidence(spark, d).select("procedure", F.round(learning.prob_better(*_columns()), 6).alias("p"))


@query(_EVIDENCE + f" SELECT procedure, round({_BELOW}, 6) AS p FROM e")
def q82_prob_below(spark, d):
    s, f, _, _ = _columns()
    return _evidence(spark, d).select("procedure", F.round(learning.prob_below(s, f, 0.5), 6).alias("p"))


@query(_EVIDENCE + f" SELECT procedure, (s + f >= 5) AND CASE WHEN hs + hf >= 3 THEN {_PH} >= 0.95 ELSE {_BELOW} >= 0.95 END AS harmful, (s + f >= 3) AND ((s+1)/(s+f+2) - (hs+1)/(hs+hf+2) >= 0.05) AND {_P} >= 0.95 AS beats FROM e")
def q83_policy(spark, d):
    c = _columns()
    return _evidence(spark, d).select("procedure", learning.harmful(*c).alias("harmful"), learning.beats(*c).alias("beats"))


@query(_EVIDENCE + f" SELECT procedure, CASE WHEN hs + hf >= 50 OR (s + f >= 10 AND hs + hf >= 10 AND (({_P}) <= 0.05 OR ({_P}) >= 0.95)) THEN 0.02 ELSE 0.1 END::DOUBLE AS rate FROM e")
def q84_holdout_rate(spark, d):
    return _evidence(spark, d).select("procedure", learning.holdout_rate(F.lit(None).cast("double"), learning.established(*_columns())).alias("rate"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN CASE WHEN datediff('day', o_orderdate, TIMESTAMP '1998-12-01') >= 90 THEN 'archived'
  WHEN datediff('day', o_orderdate, TIMESTAMP '1998-12-01') >= 30 THEN 'stale' ELSE 'active' END
  WHEN o_orderkey % 2 = 0 THEN CASE WHEN datediff('day', o_orderdate, TIMESTAMP '1998-12-01') >= 90 THEN 'archived' ELSE 'candidate' END ELSE 'retired' END AS state FROM orders""")
def q85_aging(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "stale").when(F.col("o_orderkey") % 2 == 0, "candidate").otherwise("retired")
    return table(spark, d, "orders").select("o_orderkey", learning.aged(state, F.datediff(F.lit("1998-12-01"), F.col("o_orderdate"))).alias("state"))


@query("""WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
  n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM g)
  SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM n GROUP BY 1, 2""")
def q90_session_idle(spark, d):
    return sessions.idle_sessions(table(spark, d, "events"), "user_id", "ts")


@query("""SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value, min(ts) AS first_place FROM events GROUP BY 1, 2""")
def q93_last_write_wins(spark, d):
    log = table(spark, d, "events").select(F.struct("user_id", F.get_json_object("props", "$.k").cast("int").alias("id")).alias("key"), "ts", "event_id", "event_type", "value")
    return sessions.last_write_wins(log, "key", ["ts", "event_id"]).select("key.user_id", "key.id", "event_type", "value", "first_place")


@query(f"""WITH {EVENTS}, r AS (SELECT session, seq, type, CASE WHEN type = 'error' THEN seq - 1 - CAST(json_extract(props, '$.k') AS INT) % 4 END AS target FROM ev)
  SELECT session, seq, type FROM r WHERE target IS NULL AND NOT EXISTS (SELECT 1 FROM r x WHERE x.session = r.session AND x.seq > r.seq AND x.target <= r.seq)""")
def q94_rewind(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    log = events(spark, d).withColumn("target", F.when(F.col("type") == "error", F.col("seq") - 1 - k % 4))
    return sessions.after_rewinds(log, "session", "seq", "target").select("session", "seq", "type")


@query("""SELECT conv_id, turn, text IS NOT NULL AND (lower(text) LIKE '%fix%' OR lower(text) LIKE '%error%') AS symptom FROM conversations WHERE role = 'user'""")
def q95_symptom_prompts(spark, d):
    low = F.lower("text")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", (F.col("text").isNotNull() & (low.contains("fix") | low.contains("error"))).alias("symptom"))


def _words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(translate(regexp_replace({column}, '`[^`]*`|\"[^\"]*\"|“[^”]*”', ' ', 'g'), '‘’', '''''')), '[^\\p{{L}}\\p{{N}}''\\-_]+'), lambda x: x <> '')"


def _has(words) -> str:
    return "list_has_any(w, [" + ", ".join("'" + x.replace("'", "''") + "'" for x in words) + "])"


_SYMPTOM = "(" + _has(fixed.FIX_WORDS) + " OR " + " OR ".join("contains(p, '" + x.replace("'", "''") + "')" for x in fixed.FIX_PHRASES) + ")"


@query(f"""WITH x AS (SELECT conv_id, turn, {_words_sql('text')} AS w, lower(translate(regexp_replace(text, '`[^`]*`|"[^"]*"|“[^”]*”', ' ', 'g'), '‘’', '''''')) AS p FROM conversations WHERE role = 'user')
  SELECT conv_id, turn, CASE WHEN {_has(fixed.DOC_WORDS)} THEN 'meta' WHEN {_has(('fix',))} THEN 'fix' WHEN {_has(fixed.TEST_WORDS)} AND ({_has(fixed.WRITE_WORDS)} OR NOT {_SYMPTOM}) THEN 'meta'
  WHEN {_SYMPTOM} THEN 'fix' WHEN {_has(fixed.ADD_WORDS)} THEN 'add' END AS kind FROM x""")
def q49_task_kind(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.task_kind(F.col("text")).alias("kind"))
