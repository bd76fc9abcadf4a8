"""Relational queries of the store: filters, joins, grouped aggregates, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import store
from tracemill.plans.common import EVENTS, events, registrar, table

query, QUERIES, ORACLE = registrar()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P')")
def q01_list_serving(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS revision FROM orders")
def q02_revisions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("revision"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'P'))")
def q03_recallable_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT user_id AS session, EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.value > 90) AS injected FROM events e")
def q04_injected_exists(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.coalesce(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 90)), F.lit(False)).alias("injected"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, TIMESTAMP '2000-01-01') AS used_at FROM orders WHERE o_orderstatus <> 'P'")
def q05_usage_coalesce(spark, d):
    used = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.expr("TIMESTAMP_NTZ '2000-01-01'"))
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", used.alias("used_at"))


@query("SELECT event_id, greatest(least(CAST(json_extract(props, '$.k') AS DOUBLE) / 80, 1.0), 0.1) AS holdout FROM events")
def q06_config_kv(spark, d):
    k = F.get_json_object("props", "$.k").cast("double") / 80
    return table(spark, d, "events").select("event_id", F.greatest(F.least(k, F.lit(1.0)), F.lit(0.1)).alias("holdout"))


@query("""SELECT e.event_type AS procedure, count(*) AS runs, count(*) FILTER (l.quality = 1) AS succeeded, count(*) FILTER (l.quality = 0) AS failed,
  round(avg(CASE WHEN l.quality = 1 THEN e.value END), 6) AS mean_when_good, max(e.ts) AS last_at
  FROM events e LEFT JOIN labels l ON e.event_id = l.doc_id GROUP BY 1""")
def q11_outcome_summary(spark, d):
    both = table(spark, d, "events").join(table(spark, d, "labels"), F.col("event_id") == F.col("doc_id"), "left")
    return both.groupBy(F.col("event_type").alias("procedure")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("quality") == 1).alias("succeeded"), F.count_if(F.col("quality") == 0).alias("failed"),
        F.round(F.avg(F.when(F.col("quality") == 1, F.col("value"))), 6).alias("mean_when_good"), F.max("ts").alias("last_at"),
    )


@query("""SELECT o_orderkey AS call, l_linenumber AS result, CASE WHEN l_orderkey IS NULL THEN 'interrupted' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS outcome
  FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 40) ON o_orderkey = l_orderkey""")
def q15_call_result_join(spark, d):
    results = table(spark, d, "lineitem").where("l_quantity > 40")
    return table(spark, d, "orders").join(results, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("call"), F.col("l_linenumber").alias("result"),
        F.when(F.col("l_orderkey").isNull(), "interrupted").when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("outcome"),
    )


@query("""SELECT user_id AS procedure, event_type AS revision, value > 50 AS holdout, count(*) AS n, count(*) FILTER (CAST(json_extract(props, '$.k') AS INT) >= 50) AS successes
  FROM events GROUP BY ALL""")
def q20_evidence(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("procedure"), F.col("event_type").alias("revision"), (F.col("value") > 50).alias("holdout")).agg(F.count("*").alias("n"), F.count_if(k >= 50).alias("successes"))


@query("""SELECT user_id AS procedure, count(*) FILTER (value <= 50) AS injected, count(*) FILTER (value > 50) AS held_out, count(DISTINCT event_type) AS revisions FROM events GROUP BY 1""")
def q21_family_evidence(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("procedure")).agg(F.count_if(F.col("value") <= 50).alias("injected"), F.count_if(F.col("value") > 50).alias("held_out"), F.countDistinct("event_type").alias("revisions"))


@query("""SELECT (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT user_id) FROM events WHERE event_type <> 'view') AS sessions,
  (SELECT count(*) FROM documents) AS documents, (SELECT max(ts) FROM events) AS last_at, (SELECT count(*) FROM labels WHERE toxic = 1) AS flagged""")
def q22_stats(spark, d):
    e = table(spark, d, "events").agg(F.count("*").alias("events"), F.countDistinct(F.when(F.col("event_type") != "view", F.col("user_id"))).alias("sessions"), F.max("ts").alias("last_at"))
    return e.crossJoin(table(spark, d, "documents").agg(F.count("*").alias("documents"))).crossJoin(table(spark, d, "labels").agg(F.count_if(F.col("toxic") == 1).alias("flagged")))


@query("SELECT event_type AS reason, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def q23_report_absorb(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("SELECT split_part(split_part(text, ' ', 1) || ': ' || source, ':', 1) AS reason, count(*) AS n FROM documents GROUP BY 1")
def q24_reason_histogram(spark, d):
    rejection = F.concat(F.substring_index("text", " ", 1), F.lit(": "), "source")
    return table(spark, d, "documents").groupBy(F.substring_index(rejection, ":", 1).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def q30_topk_rejections(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS n
  FROM lineitem WHERE l_linestatus = 'O') WHERE n = 1""")
def q31_incumbent(spark, d):
    return table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))


@query("""SELECT o_custkey AS family, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS created_by, count(*) AS seen,
  count(DISTINCT o_orderpriority) AS revisions, max(o_orderdate) AS updated_at, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS signatures
  FROM orders GROUP BY 1""")
def q51_upsert_states(spark, d):
    place = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("family")).agg(
        F.min_by("o_orderkey", place).alias("created_by"), F.count("*").alias("seen"), F.countDistinct("o_orderpriority").alias("revisions"),
        F.max("o_orderdate").alias("updated_at"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("signatures"),
    )


@query(f"""WITH {EVENTS}, m AS (SELECT session, max(seq) FILTER (type = 'signup') AS mark FROM ev GROUP BY 1)
  SELECT ev.session, ev.seq, ev.type FROM ev JOIN m USING (session) WHERE m.mark IS NULL OR ev.seq > m.mark""")
def q91_watermark(spark, d):
    w = Window.partitionBy("session")
    rows = events(spark, d).withColumn("mark", F.max(F.when(F.col("type") == "signup", F.col("seq"))).over(w))
    return rows.where(F.col("mark").isNull() | (F.col("seq") > F.col("mark"))).select("session", "seq", "type")


@query("SELECT user_id AS transcript, event_type AS harness, bool_or(value > 95) AS ended, count(*) AS queued FROM events GROUP BY ALL")
def q92_queue_coalesce(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("transcript"), F.col("event_type").alias("harness")).agg(F.bool_or(F.col("value") > 95).alias("ended"), F.count("*").alias("queued"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def q97_forget_anti(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(gone, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT o_custkey AS session, min(o_orderkey) AS harness_of, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS state, max(o_orderdate) AS updated_at FROM orders GROUP BY 1""")
def q98_progress_upsert(spark, d):
    place = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.min("o_orderkey").alias("harness_of"), F.max_by("o_orderstatus", place).alias("state"), F.max("o_orderdate").alias("updated_at"))


# The store's facts from events: users are procedures, k modulo 3 their revisions.
_K = "CAST(json_extract(props, '$.k') AS INT)"
_FACTS = f"""WITH e AS (SELECT *, {_K} AS k, 'p' || user_id AS p FROM events),
  fact AS (SELECT p AS procedure, k % 3 AS revision, ['active', 'stale', 'candidate', 'archived', 'quarantined', 'retired'][1 + k % 6] AS state, event_type <> 'view' AS learned, ts AS "at", event_id FROM e),
  rev AS (SELECT p AS procedure, k % 3 AS revision, 'r' || user_id % 7 AS repo, arg_min(CASE WHEN k % 2 = 0 THEN 'active' ELSE 'candidate' END, (ts, event_id)) AS state, min(ts) AS "at" FROM e WHERE event_type = 'signup' GROUP BY 1, 2, 3),
  inj AS (SELECT event_id AS injection, p AS procedure, k % 3 AS revision, value > 80 AS holdout, ts AS "at" FROM e WHERE event_type = 'click'),
  done AS (SELECT event_id - k AS injection, max_by(CASE WHEN k % 4 = 0 THEN 'failed' WHEN k % 4 = 1 THEN 'unjudged' ELSE 'succeeded' END, (ts, event_id)) AS outcome FROM e WHERE event_type IN ('purchase', 'error') GROUP BY 1),
  settled AS (SELECT inj.*, outcome FROM inj LEFT JOIN done USING (injection))"""


def _facts(spark, d):
    """States, revisions, injections and settlements as facts; event ids keep facts of one time apart."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select("*", k.alias("k"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("procedure"), (k % 3).alias("revision"), F.col("ts").alias("at"))
    names = F.array(*map(F.lit, ("active", "stale", "candidate", "archived", "quarantined", "retired")))
    states = e.select("procedure", "revision", names[F.col("k") % 6].alias("state"), (F.col("event_type") != "view").alias("learned"), "at")
    first = e.where("event_type = 'signup'").groupBy("procedure", "revision", "user_id").agg(F.min_by(F.when(F.col("k") % 2 == 0, "active").otherwise("candidate"), F.struct("ts", "event_id")).alias("state"), F.min("ts").alias("at"))
    revisions = first.select("procedure", "revision", F.lit("f").alias("family"), F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("repo"), F.lit("t").alias("title"), "state", "at")
    injections = e.where("event_type = 'click'").select(F.col("event_id").alias("injection"), F.col("user_id").alias("session"), "procedure", "revision", (F.col("value") > 80).alias("holdout"), F.lit("prompt").alias("cue"), "at")
    outcome = F.when(F.col("k") % 4 == 0, "failed").when(F.col("k") % 4 == 1, "unjudged").otherwise("succeeded")
    settlements = e.where("event_type IN ('purchase', 'error')").select((F.col("event_id") - F.col("k")).alias("injection"), F.col("event_id").alias("task"), outcome.alias("outcome"), "at")
    reminders = e.where("false").select(F.col("event_id").alias("injection"), "at")
    return states, revisions, injections, settlements, reminders


@query(_FACTS + """, step AS (SELECT fact.*, list_contains(['active', 'stale', 'candidate'], fact.state) AS serving FROM fact JOIN rev ON rev.procedure = fact.procedure AND rev.revision = fact.revision WHERE fact."at" >= rev."at"),
  folded AS (SELECT procedure, revision, list((CASE WHEN learned THEN 'l' ELSE 's' END) || state ORDER BY "at", learned, state) AS steps FROM step GROUP BY 1, 2)
  SELECT procedure, revision, list_reduce(list_prepend('s' || state, coalesce(steps, [])), lambda now, x: CASE WHEN x[1] = 's' OR substr(now, 2) IN ('active', 'stale', 'candidate') THEN x ELSE now END)[2:] AS state
  FROM rev LEFT JOIN folded USING (procedure, revision)""")
def q115_states(spark, d):
    states, revisions, *_ = _facts(spark, d)
    return store.current_states(states, revisions).select("procedure", "revision", "state")


@query(_FACTS + """ SELECT procedure, revision, count(*) FILTER (NOT holdout AND outcome = 'succeeded') AS successes, count(*) FILTER (NOT holdout AND outcome = 'failed') AS failures,
  count(*) FILTER (NOT holdout) AS injections, count(*) FILTER (holdout) AS holdouts, max(CASE WHEN NOT holdout AND outcome = 'succeeded' THEN "at" END) AS last_success_at FROM settled GROUP BY 1, 2""")
def q116_outcome_totals(spark, d):
    _, _, injections, settlements, reminders = _facts(spark, d)
    return store.outcome_totals(store.settled_injections(injections, settlements, reminders))


@query(_FACTS + """, own AS (SELECT procedure, revision, count(*) FILTER (outcome = 'succeeded') AS s, count(*) FILTER (outcome = 'failed') AS f FROM settled WHERE NOT holdout GROUP BY 1, 2),
  held AS (SELECT procedure, count(*) FILTER (outcome = 'succeeded') AS hs, count(*) FILTER (outcome = 'failed') AS hf FROM settled WHERE holdout GROUP BY 1),
  used AS (SELECT procedure, revision, max("at") AS "at" FROM settled WHERE outcome IS NOT NULL GROUP BY 1, 2)
  SELECT procedure, revision, coalesce(s, 0) AS s, coalesce(f, 0) AS f, coalesce(hs, 0) AS hs, coalesce(hf, 0) AS hf, coalesce(used."at", rev."at") AS used_at FROM rev LEFT JOIN own USING (procedure, revision) LEFT JOIN held USING (procedure) LEFT JOIN used USING (procedure, revision)""")
def q117_evidence_and_use(spark, d):
    _, revisions, injections, settlements, reminders = _facts(spark, d)
    settled = store.settled_injections(injections, settlements, reminders)
    use = store.usage(revisions, settled).select("procedure", "revision", "used_at")
    return store.evidence(revisions, settled).join(use, ["procedure", "revision"]).select("procedure", "revision", "s", "f", "hs", "hf", "used_at")


@query(f"""SELECT user_id AS session, {_K} AS first_seq, arg_min(event_type, (ts, event_type)) AS summary, min(ts) AS "at" FROM events GROUP BY 1, 2""")
def q118_first_extractions(spark, d):
    facts = table(spark, d, "events").select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("int").alias("first_seq"), F.col("event_type").alias("summary"), F.col("ts").alias("at"))
    return store.first_of(facts, "session", "first_seq").select("session", "first_seq", "summary", "at")


@query(_FACTS + """, gone AS (SELECT procedure, max("at") AS gone FROM (SELECT p AS procedure, ts AS "at" FROM e WHERE event_type = 'error' AND k % 10 = 0
    UNION ALL SELECT rev.procedure, x.ts FROM rev JOIN e AS x ON rev.repo = 'r' || x.k % 14 AND rev."at" <= x.ts WHERE x.event_type = 'error' AND x.k % 25 = 1) GROUP BY 1),
  left_ AS (SELECT inj.* FROM inj LEFT JOIN gone USING (procedure) WHERE gone IS NULL OR "at" > gone)
  SELECT procedure, count(*) AS injections, count(done.injection) AS settled FROM left_ LEFT JOIN done USING (injection) GROUP BY 1""")
def q119_forget_cascade(spark, d):
    states, revisions, injections, settlements, reminders = _facts(spark, d)
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("ts").alias("at"))
    one = e.where("k % 10 = 0").select(F.lit("procedure").alias("what"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("value"), "at")
    repo = e.where("k % 25 = 1").select(F.lit("repo").alias("what"), F.concat(F.lit("r"), (F.col("k") % 14).cast("string")).alias("value"), "at")
    none = e.where("false").select(F.col("user_id").alias("session"), "at")
    extractions = e.where("false").select(F.lit("").alias("procedure"), "at")
    left = store.remembered({"forgotten": one.unionByName(repo), "revisions": revisions, "injections": injections, "states": states, "extractions": extractions, "progress": none, "settlements": settlements, "reminders": reminders})
    settled = store.settled_injections(left["injections"], left["settlements"], left["reminders"])
    return settled.groupBy("procedure").agg(F.count("*").alias("injections"), F.count("outcome").alias("settled"))


@query(f"""WITH e AS (SELECT user_id AS session, event_type, {_K} AS k, ts, event_id FROM events),
  n AS (SELECT session, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS harness, arg_max(k, (ts, event_id)) FILTER (event_type <> 'view') AS extracted_through, arg_max(event_type = 'view', (ts, event_id)) AS ended, max(ts) AS updated_at FROM e GROUP BY 1)
  SELECT session, harness, CAST(extracted_through AS BIGINT) AS extracted_through, updated_at FROM n WHERE NOT ended AND harness IS NOT NULL""")
def q120_open_sessions(spark, d):
    said = F.col("event_type") != "view"
    k = F.get_json_object("props", "$.k").cast("bigint")
    facts = table(spark, d, "events").select(F.col("ts").alias("at"), "event_id", F.col("user_id").alias("session"), F.when(said, F.col("event_type")).alias("harness"), F.when(said, F.lit("t")).alias("transcript"), F.lit("r").alias("repo"), F.when(said, k).alias("extracted_through"), (~said).alias("ended"))
    return store.open_sessions(store.current_progress(facts)).select("session", "harness", "extracted_through", "updated_at")
