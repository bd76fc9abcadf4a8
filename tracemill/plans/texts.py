"""Queries that apply the text functions to documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import fixed, redaction, text
from tracemill.plans.common import registrar, table

query, QUERIES, ORACLE = registrar()


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def chained(column: str, steps) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return column


FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"
STOP = "(" + ", ".join(quoted(w) for w in fixed.STOP_WORDS) + ")"
TERMS = f"list_filter(list_transform(regexp_split_to_array(translate(lower({{}}), '{FOLD_FROM}', '{FOLD_TO}'), '[^\\p{{{{L}}}}\\p{{{{N}}}}_\\-./]+'), lambda w: regexp_replace(w, '^[_\\-./]+|[_\\-./]+$', '', 'g')), lambda w: w <> '' AND w NOT IN {STOP})"
SECRETS = [(p, f"\\1[REDACTED:{n}]{fixed.AFTER_SECRET.get(n, '')}") for n, p in fixed.SECRETS]
# an address of git's own at a remote is put aside first
EMAIL = [(r"(^|[^A-Za-z0-9._%+-])git@([A-Za-z0-9.-]+\.[A-Za-z]{2,})([:/])", "\\1git\u0001\\2\\3"), (fixed.EMAIL, "[REDACTED:email]"), ("\u0001", "@")]


def _docs(spark, d):
    return table(spark, d, "documents")


@query(f"SELECT doc_id, array_to_string({TERMS.format('text')}, ' ') AS terms FROM documents")
def q60_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(text.terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH t AS (SELECT doc_id, {TERMS.format('text')} AS t FROM documents),
  g AS (SELECT doc_id, 2 AS n, i, array_to_string(t[i:i+1], ' ') AS p FROM (SELECT *, unnest(range(1, len(t))) AS i FROM t) UNION ALL SELECT doc_id, 3, i, array_to_string(t[i:i+2], ' ') FROM (SELECT *, unnest(range(1, len(t) - 1)) AS i FROM t)),
  k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY min(i * 4 + n)) AS nth FROM g GROUP BY doc_id, p)
  SELECT doc_id, count(*) AS phrases, min(p) AS first_phrase FROM k WHERE nth <= {fixed.TERM_LIMIT} GROUP BY 1""")
def q61_phrases(spark, d):
    p = _docs(spark, d).select("doc_id", F.explode(text.phrases(F.col("text"))).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("phrases"), F.min("p").alias("first_phrase"))


@query(f"SELECT doc_id, {chained('text', EMAIL)} AS redacted FROM documents")
def q70_redact_email(spark, d):
    return _docs(spark, d).select("doc_id", text.redact_emails(F.col("text")).alias("redacted"))


@query(None)  # each match is decided by its name and value; tests hold it against a table of cases
def q71_redact_assign(spark, d):
    return _docs(spark, d).select("doc_id", redaction.redact_secrets(F.col("text")).alias("redacted"), redaction.contains_secret(F.col("text")).alias("secret"))


@query(None)  # as above
def q72_redact_all(spark, d):
    return _docs(spark, d).select("doc_id", text.redact(F.col("text"), "/home/user").alias("redacted"))


@query(f"SELECT doc_id, {chained('text', SECRETS)} AS redacted FROM documents")
def q69_redact_known_forms(spark, d):
    return _docs(spark, d).select("doc_id", redaction.known_forms(F.col("text")).alias("redacted"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN {quoted(n)}" for n, p in fixed.DANGERS) + " END AS danger FROM documents")
def q73_danger_lint(spark, d):
    return _docs(spark, d).select("doc_id", text.danger(F.col("text")).alias("danger"))


_PAGE_ERRORS = "'Error: ' || url || ' at 0x1F line ' || page_id || chr(10) || 'done'"


@query(f"SELECT page_id, rtrim(substr(trim({chained(f'lower(split_part({_PAGE_ERRORS}, chr(10), 1))', fixed.VOLATILE)}), 1, 120)) AS signature FROM pages")
def q74_error_signature(spark, d):
    out = F.concat(F.lit("Error: "), "url", F.lit(" at 0x1F line "), F.col("page_id").cast("string"), F.lit("\ndone"))
    return table(spark, d, "pages").select("page_id", text.error_signature(out).alias("signature"))


_SAID = "text || CASE doc_id % 4 WHEN 0 THEN chr(10) || '3 passed, 1 failed' WHEN 1 THEN chr(10) || 'test result: ok. 5 passed' WHEN 2 THEN chr(10) || '   Finished dev target(s)' ELSE '' END"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(t, {quoted(fixed.FAILED_OUTPUT)}) THEN 'failed' WHEN regexp_matches(t, {quoted(fixed.PASSED_OUTPUT)}) OR doc_id % 3 = 0 AND regexp_matches(t, {quoted(fixed.BUILT_OUTPUT)}) THEN 'passed' END AS verdict FROM (SELECT doc_id, {_SAID} AS t FROM documents)")
def q75_check_verdict(spark, d):
    said = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "\n3 passed, 1 failed").when(F.col("doc_id") % 4 == 1, "\ntest result: ok. 5 passed").when(F.col("doc_id") % 4 == 2, "\n   Finished dev target(s)").otherwise(""))
    return _docs(spark, d).select("doc_id", text.output_verdict(said, F.col("doc_id") % 3 == 0).alias("verdict"))


@query("""SELECT page_id, regexp_replace(html, '`[^`]*`|"[^"]*"|“[^”]*”', ' ', 'g') AS skeleton FROM pages""")
def q76_skeleton(spark, d):
    return table(spark, d, "pages").select("page_id", text.skeleton(F.col("html")).alias("skeleton"))


@query("""WITH x AS (SELECT doc_id, string_split('--- a' || chr(10) || '@@ -' || doc_id || ',2 +1 @@' || chr(10) || '+' || replace(text, '. ', '.' || chr(10) || '-'), chr(10)) AS l FROM documents),
  y AS (SELECT doc_id, list_filter(l, lambda x: NOT starts_with(x, '@@'))[2:] AS l FROM x)
  SELECT doc_id, len(list_filter(l, lambda x: starts_with(x, '+'))) AS added, len(list_filter(l, lambda x: starts_with(x, '-'))) AS removed, CAST(doc_id AS INT) AS start FROM y""")
def q77_diff_counts(spark, d):
    diff = F.concat(F.lit("--- a\n@@ -"), F.col("doc_id").cast("string"), F.lit(",2 +1 @@\n+"), F.replace("text", F.lit(". "), F.lit(".\n-")))
    return _docs(spark, d).withColumn("c", text.unified_diff(diff)).select("doc_id", F.col("c.added").cast("bigint").alias("added"), F.col("c.removed").cast("bigint").alias("removed"), F.col("c.starts")[0].alias("start"))


def _name_sql(line: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({line}, {quoted(p)}) THEN regexp_extract({line}, {quoted(p)}, 1) END" for p in (fixed.DEFINITION, fixed.CONSTANT, fixed.ARROW)) + ")"


_CODE = "'def d' || doc_id || '():' || chr(10) || '  pub const LIMIT: u8 = 1;' || chr(10) || 'export const list' || doc_id || ' = (a) => {' || chr(10) || 'impl Show for Page {' || chr(10) || replace(text, '. ', chr(10) || 'class ')"


@query(f"""SELECT doc_id, array_to_string(list(name ORDER BY place)[1:5], ',') AS symbols FROM (SELECT doc_id, name, min(place) AS place FROM
  (SELECT doc_id, {_name_sql('line')} AS name, place FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM (SELECT doc_id, string_split({_CODE}, chr(10)) AS l FROM documents))) WHERE name IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def q78_symbols(spark, d):
    i = F.col("doc_id").cast("string")
    code = F.concat(F.lit("def d"), i, F.lit("():\n  pub const LIMIT: u8 = 1;\nexport const list"), i, F.lit(" = (a) => {\nimpl Show for Page {\n"), F.replace("text", F.lit(". "), F.lit("\nclass ")))
    return _docs(spark, d).select("doc_id", F.array_join(text.symbols(text.lines(code)), ",").alias("symbols"))


_DOC = "replace(html, '\"', '`') || chr(10) || '```sh' || chr(10) || '$ make check ' || page_id || chr(10) || '```' || chr(10) || '    npm test' || chr(10) || 'run `tox` now'"
_BARE = "regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '^(?:\\$ )+', '')"


@query(f"""WITH p AS (SELECT page_id, unnest(s) AS part, unnest(range(len(s))) AS n FROM (SELECT page_id, regexp_split_to_array({_DOC}, {quoted(text.FENCE)}) AS s FROM pages)),
  l AS (SELECT page_id, n, unnest(regexp_split_to_array(part, '\\r?\\n')) AS line FROM p),
  c AS (SELECT page_id, unnest(CASE WHEN n % 2 = 1 OR starts_with(line, '    ') OR starts_with(line, chr(9)) THEN [{_BARE.format('line')}] ELSE regexp_extract_all(line, '`([^`\\n]+)`', 1) END) AS code FROM l)
  SELECT page_id, count(*) AS commands, count(DISTINCT code) AS different, min(code) AS first FROM c WHERE code <> '' GROUP BY 1""")
def q79_doc_commands(spark, d):
    doc = F.concat(F.replace("html", F.lit('"'), F.lit("`")), F.lit("\n```sh\n$ make check "), F.col("page_id").cast("string"), F.lit("\n```\n    npm test\nrun `tox` now"))
    code = table(spark, d, "pages").select("page_id", F.explode(text.doc_code(doc)).alias("code"))
    return code.groupBy("page_id").agg(F.count("*").alias("commands"), F.countDistinct("code").alias("different"), F.min("code").alias("first"))


@query("""WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: lower(x)) AS w FROM documents)
  SELECT doc_id, substr(sha256(source || chr(10) || array_to_string(list_sort(list_distinct(w[1:4])), chr(10)) || chr(10) || lang), 1, 12) AS family FROM w JOIN documents USING (doc_id)""")
def q47_family_hash(spark, d):
    targets = F.slice(F.split(F.lower("text"), " "), 1, 4)
    return _docs(spark, d).select("doc_id", text.family(F.col("source"), targets, F.col("lang")).alias("family"))


@query("""SELECT l_orderkey, array_to_string(list('{"kind":"' || l_returnflag || '","target":' || l_partkey || '}' ORDER BY l_linenumber, l_partkey, l_returnflag), ',') AS signature FROM lineitem GROUP BY 1""")
def q48_signature(spark, d):
    step = F.to_json(F.struct(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("target")))
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", step.alias("s"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(steps, lambda x: x["s"]), ",").alias("signature"))


@query("WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), g AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY 1, 2), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM g) SELECT d.doc_id, round(-sum(p * log2(p)), 6) AS bits FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY 1")
def q25_entropy(spark, d):
    return _docs(spark, d).select("doc_id", F.round(text.byte_entropy(F.col("text")), 6).alias("bits"))


def _artifact_sql() -> str:
    cases = " ".join(f"WHEN {quoted(w)} THEN {quoted(k if isinstance(k, str) else '+'.join(k))}" for w, k in fixed.ARTIFACTS.items())
    words = "list_filter(regexp_split_to_array(lower(translate(regexp_replace(text, '`[^`]*`|\"[^\"]*\"|“[^”]*”', ' ', 'g'), '‘’', '''''')), '[^\\p{L}\\p{N}''\\-_]+'), lambda x: x <> '')"
    return f"""WITH w AS (SELECT doc_id, unnest({words}) AS w FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' add a flag to the table' ELSE '' END AS text FROM documents)),
  k AS (SELECT DISTINCT doc_id, unnest(string_split(CASE w {cases} END, '+')) AS k FROM w)
  SELECT d.doc_id, coalesce(string_agg(k, ',' ORDER BY k), '') AS artifacts FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id AND k IS NOT NULL GROUP BY 1"""


@query(_artifact_sql())
def q50_artifacts(spark, d):
    asked = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " add a flag to the table").otherwise(""))
    return _docs(spark, d).select("doc_id", F.array_join(text.artifacts(asked), ",").alias("artifacts"))
