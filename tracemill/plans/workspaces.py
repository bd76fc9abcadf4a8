"""Roots, identities and checked-out commits: pages stand for directories and repositories, events for moments and reflogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import workspaces
from tracemill.plans.common import registrar, table

query, QUERIES, ORACLE = registrar()

_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616)"


def _hashed(x: str) -> str:
    """FNV-1a of an ASCII text that isn't empty, as 16 digits."""
    return f"lpad(lower(to_hex(({_FNV.format(x)})::UBIGINT)), 16, '0')"


REMOTE = """rtrim(lower(split_part(split_part(url, '://', 2), '/', 1)) || '/' || array_to_string(string_split(split_part(split_part(url, '://', 2), '?', 1), '/')[2:], '/'), '/')"""


@query(f"""SELECT page_id, {REMOTE} AS remote, {_hashed('(' + REMOTE + ')')} AS hash FROM pages CROSS JOIN range(3) t(form)""")
def q130_remotes(spark, d):
    host, path = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)), F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "^[a-z]+://[^/]*/", "")
    forms = F.array(F.concat(F.lit(" https://me:pw@"), F.upper(host), F.lit(":8443/"), path, F.lit(".git ")), F.concat(F.lit("git@"), host, F.lit(":"), path, F.lit(".git")), F.concat(F.lit("ssh://git@"), host, F.lit("/"), path, F.lit("/")))
    rows = table(spark, d, "pages").select("page_id", F.explode(forms).alias("said")).select("page_id", workspaces.normalized_remote(F.col("said")).alias("remote"))
    return rows.select("page_id", "remote", workspaces.fnv64(F.col("remote")).alias("hash"))


_CWD = "'/' || array_to_string(string_split(split_part(split_part(url, '://', 2), '?', 1), '/'), '/')"


@query(f"""WITH p AS (SELECT page_id, {_CWD} AS cwd, string_split({_CWD}, '/')[2:] AS parts FROM pages), u AS (SELECT DISTINCT cwd, parts FROM p),
  a AS (SELECT cwd, '/' || array_to_string(parts[1:n], '/') AS dir, len(parts) - n AS far FROM (SELECT cwd, parts, unnest(range(0, len(parts) + 1)) AS n FROM u)),
  m AS (SELECT '/' || parts[1] || CASE WHEN page_id % 3 = 0 THEN '' ELSE '/' || parts[2] END AS dir, CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS rank FROM p WHERE page_id % 2 = 0 UNION ALL SELECT '/', 3),
  f AS (SELECT cwd, dir, row_number() OVER (PARTITION BY cwd ORDER BY rank, far) AS n FROM a JOIN m USING (dir) WHERE rank IS NOT NULL AND (rank < 3 OR dir <> '/'))
  SELECT u.cwd, coalesce(f.dir, u.cwd) AS root FROM u LEFT JOIN f ON u.cwd = f.cwd AND n = 1""")
def q131_project_roots(spark, d):
    cwd = F.concat(F.lit("/"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)))
    pages = table(spark, d, "pages").select("page_id", cwd.alias("cwd")).withColumn("parts", F.split("cwd", "/"))
    number = F.col("page_id")
    dir_ = F.concat(F.lit("/"), F.col("parts")[1], F.when(number % 3 == 0, "").otherwise(F.concat(F.lit("/"), F.col("parts")[2])))
    name = F.when(number % 5 == 0, ".git").when(number % 5 == 1, ".hg").when(number % 5 == 2, "go.mod").otherwise("notes.txt")
    files = pages.where(number % 2 == 0).select(dir_.alias("dir"), name.alias("name")).unionByName(pages.select(F.lit("/").alias("dir"), F.lit("Makefile").alias("name")))
    return workspaces.project_roots(pages, files)


@query(f"""WITH s AS (SELECT source, count(*) AS docs, count(*) % 3 <> 0 AS has_head, count(*) % 2 = 0 AS shallow, min(md5(text)) FILTER (doc_id % 4 = 0) AS commit,
    coalesce(min_by('h' || doc_id, doc_id) FILTER (doc_id % 7 = 0), min_by('h' || doc_id, doc_id) FILTER (doc_id % 5 = 0)) AS host FROM documents WHERE source IS NOT NULL GROUP BY 1)
  SELECT '/w/' || source AS root, CASE WHEN has_head AND shallow AND host IS NOT NULL THEN 'remote-' || {_hashed("(host || '/r')")} WHEN has_head AND NOT shallow AND commit IS NOT NULL THEN commit ELSE 'path-' || {_hashed("('/w/' || source)")} END AS repo FROM s""")
def q132_repository_ids(spark, d):
    docs = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", F.concat(F.lit("/w/"), "source").alias("root"), "text")
    roots = docs.groupBy("root").agg((F.count("*") % 3 != 0).alias("has_head"), (F.count("*") % 2 == 0).alias("shallow"))
    commits = docs.where("doc_id % 4 = 0").select("root", F.md5("text").alias("commit"))
    name = F.when(F.col("doc_id") % 7 == 0, "origin").otherwise("fork")
    remotes = docs.where("doc_id % 7 = 0 OR doc_id % 5 = 0").select("root", name.alias("name"), F.col("doc_id").alias("place"), F.concat(F.lit("https://H"), F.col("doc_id").cast("string"), F.lit("/r.git")).alias("url"))
    return workspaces.repository_ids(roots, commits, remotes)


@query("""WITH e AS (SELECT event_id, 'r' || user_id % 5 AS root, event_type, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 30 HOUR ELSE ts END AS moment FROM events),
  g AS (SELECT root, moment, event_id, md5(event_id::VARCHAR) AS commit FROM e WHERE event_type IN ('purchase', 'signup'))
  SELECT m.event_id, m.root, max_by(g.commit, g.event_id) AS head FROM e m LEFT JOIN g ON g.root = m.root AND g.moment <= m.moment GROUP BY ALL""")
def q133_commit_at(spark, d):
    late = F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 30 HOUR")).otherwise(F.col("ts"))
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("root"), "event_type", late.alias("at"))
    reflog = rows.where(F.col("event_type").isin("purchase", "signup")).select("root", "at", (-F.col("event_id")).alias("place"), F.md5(F.col("event_id").cast("string")).alias("commit"))
    return workspaces.commit_at(rows.select("event_id", "root", "at"), reflog).select("event_id", "root", "head")
