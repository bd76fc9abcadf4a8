"""Retrieval queries: documents as procedures, benchmark items as prompts, embeddings as the vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators import retrieval, vector_index
from tracemill.plans.common import registrar, table
from tracemill.plans.texts import TERMS
from tracemill.tables import durable, scratch_dir

query, QUERIES, ORACLE = registrar()
DIMS = 64


def _lists(spark, d):
    """The term lists of documents, written once for all stages of a query."""
    title = F.regexp_substr("text", F.lit(r"^[^.\n]*"))
    return durable(retrieval.term_lists(table(spark, d, "documents"), "doc_id", title, F.col("text")), "terms")


def _bm25(spark, d, lists=None):
    lists = lists or _lists(spark, d)
    stats = lists.where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return retrieval.bm25(durable(retrieval.postings(lists), "postings"), stats, table(spark, d, "benchmark"), "item_id", F.col("text"))


_BM25 = f"""WITH d AS (SELECT doc_id, {TERMS.format("regexp_extract(text, '^[^.\\n]*')")} AS t, {TERMS.format('text')} AS b FROM documents),
  l AS (SELECT doc_id, len(t) + len(b) AS dl FROM d),
  p AS (SELECT doc_id, term, CAST(sum(w) AS DOUBLE) AS f FROM (SELECT doc_id, unnest(t) AS term, 2 AS w FROM d UNION ALL SELECT doc_id, unnest(b), 1 FROM d) GROUP BY 1, 2),
  s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l WHERE dl > 0),
  q AS (SELECT item_id AS query_id, term, min(pos) AS pos FROM (SELECT item_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT item_id, {TERMS.format('text')} AS t FROM benchmark)) GROUP BY 1, 2),
  df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  k AS (SELECT query_id, term, df FROM (SELECT *, sum(df) OVER (PARTITION BY query_id ORDER BY df, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, row_number() OVER (PARTITION BY query_id ORDER BY df, pos) AS nth
    FROM q JOIN df USING (term)) WHERE total <= {fixed.POSTINGS_BUDGET} OR nth = 1),
  m AS (SELECT query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN k USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2),
  lex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m QUALIFY rank <= {fixed.TOP_STAGE})"""


@query(_BM25 + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM lex")
def q62_bm25(spark, d):
    return _bm25(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _exact(spark, d, lists=None):
    keys = (lists or _lists(spark, d)).select(F.col("doc_id").alias("item"), F.explode(F.array_distinct("b")).alias("key"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(text.terms(F.col("text")))).alias("key"))
    return retrieval.exact_hits(keys, asked)


_EXACT = f"""ek AS (SELECT DISTINCT doc_id AS item, unnest({TERMS.format('text')}) AS key FROM documents), qk AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS key FROM benchmark),
  hit AS (SELECT query_id, item, count(*) AS hits, sum(CASE WHEN contains(key, '/') THEN 2.0::DOUBLE WHEN contains(key, '_') OR contains(key, '.') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM ek JOIN qk USING (key) GROUP BY 1, 2)"""


@query("WITH " + _EXACT + " SELECT query_id, item, hits, weight FROM hit")
def q10_entity_hits(spark, d):
    return _exact(spark, d).select("query_id", "item", "hits", "weight")


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("group"), "embedding")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "group", "embedding")
    return retrieval.vector_search(e, q, DIMS)


_VECTORS = f"""e AS (SELECT vec_id, label, embedding, list_transform(embedding, lambda x: x >= 0) AS code, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings),
  near AS (SELECT a.vec_id AS query_id, b.vec_id, len(list_filter(list_zip(a.code, b.code), lambda z: z[1] <> z[2])) AS distance, a.embedding AS x, b.embedding AS y, b.scale FROM e a JOIN e b USING (label) WHERE a.vec_id % 25 = 0),
  cut AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {fixed.RESCORE}),
  cos AS (SELECT query_id, vec_id, distance, round(list_sum(list_transform(list_zip(x, y), lambda z: round(z[2]::DOUBLE / scale) * z[1]::DOUBLE)) * scale, 6) AS cosine FROM cut),
  vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM cos QUALIFY rank <= {fixed.TOP_STAGE})"""


@query("WITH " + _VECTORS + " SELECT query_id, vec_id, CAST(distance AS INT) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 64")
def q63_hamming(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("group"), "embedding")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "group", "embedding")
    return retrieval.vector_search(e, q, DIMS, top=fixed.RESCORE).select("query_id", "vec_id", "distance")


@query("WITH " + _VECTORS + " SELECT query_id, vec_id, cosine FROM vec")
def q64_cosine_rescore(spark, d):
    return _vectors(spark, d).select("query_id", "vec_id", "cosine")


@query("WITH " + _VECTORS + " SELECT query_id, vec_id, cosine FROM vec")
def q125_vector_index(spark, d):
    """As q64, from an index kept as a table: first built with some vectors missing, others of another group or turned round, then refreshed."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("group"), "embedding")
    index = vector_index.VectorIndex(spark, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}", DIMS)
    index.refresh(e.where("vec_id % 7 <> 0").withColumn("group", F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("group"))).withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))))
    index.refresh(e)
    return index.search(e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "group", "embedding")).select("query_id", "vec_id", "cosine")


# Prompts have no vectors of their own in these tables: an item's is the embedding with its number; so is a document's.
_SEMANTIC = f"""e AS (SELECT vec_id, label, embedding, list_transform(embedding, lambda x: x >= 0) AS code, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings),
  near AS (SELECT a.vec_id AS query_id, b.vec_id, len(list_filter(list_zip(a.code, b.code), lambda z: z[1] <> z[2])) AS distance,
    round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: round(z[2]::DOUBLE / b.scale) * z[1]::DOUBLE)) * b.scale, 6) AS cosine FROM e a JOIN e b USING (label) WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
  cut AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {fixed.RESCORE}),
  vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM cut QUALIFY rank <= {fixed.TOP_STAGE})"""
_FUSED = _BM25 + ", " + _EXACT + ", " + _SEMANTIC + """, pair AS (SELECT query_id, doc_id AS item, rank FROM lex UNION ALL SELECT query_id, vec_id, rank FROM vec UNION ALL SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, item) FROM hit),
  fus AS (SELECT query_id, item, round(sum(1 / (rank + 60)), 12) AS fused FROM pair GROUP BY 1, 2),
  ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, item) AS "order" FROM fus)"""


def _semantic(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("group"), "embedding")
    q = e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    return e, q, retrieval.vector_search(e, q, DIMS)


def _candidates(spark, d):
    """All signals of each candidate: (query_id, item, fused, order, weight, lexical, ranked, looked_up)."""
    lists = _lists(spark, d)
    lexical, exact = (durable(x, "stage") for x in (_bm25(spark, d, lists).select("query_id", F.col("doc_id").alias("item"), "rank"), _exact(spark, d, lists)))
    e, q, found = _semantic(spark, d)
    semantic = durable(found.select("query_id", F.col("vec_id").alias("item"), "rank", "cosine"), "stage")
    rows = retrieval.fused([lexical, exact, semantic]).join(exact.select("query_id", "item", "weight"), ["query_id", "item"], "left")
    rows = rows.join(lexical.withColumnRenamed("rank", "lexical"), ["query_id", "item"], "left").join(semantic.select("query_id", "item", F.col("cosine").alias("ranked")), ["query_id", "item"], "left")
    return retrieval.looked_up(rows.withColumn("weight", F.coalesce("weight", F.lit(0.0))), e, q)


@query(_FUSED + ' SELECT query_id, item, fused, CAST("order" AS INT) AS "order" FROM ord')
def q65_rrf_fusion(spark, d):
    return _candidates(spark, d).select("query_id", "item", "fused", "order")


# Test tables have no lifecycle, kind or family: they follow from an item's number.
def _judged(spark, d):
    item = F.col("item")
    state = F.when(item % 7 == 0, "stale").otherwise("active")
    kind = F.when(item % 5 == 0, F.lit(False)).when(item % 5 == 1, F.lit(True))
    thing = F.when(item % 11 == 0, F.lit(False))
    sure = retrieval.confident(state, F.col("weight"), F.coalesce("lexical", F.lit(99)) == 1, F.col("ranked"), F.col("looked_up"), kind, thing)
    return _candidates(spark, d).withColumn("sure", sure).withColumn("kind", kind).withColumn("family", item % 10)


_SURE = _FUSED + """, g AS (SELECT o.query_id, o.item, o.fused, o."order", coalesce(h.weight, 0) AS weight, coalesce(l.rank, 99) = 1 AS t, coalesce(v.cosine, 0) AS s, n.cosine AS c,
    CASE item % 5 WHEN 0 THEN false WHEN 1 THEN true END AS kind, item % 10 AS family FROM ord o LEFT JOIN hit h USING (query_id, item) LEFT JOIN (SELECT query_id, doc_id AS item, rank FROM lex) l USING (query_id, item)
    LEFT JOIN (SELECT query_id, vec_id AS item, cosine FROM vec) v USING (query_id, item) LEFT JOIN (SELECT query_id, vec_id AS item, cosine FROM near) n USING (query_id, item)),
  sure AS (SELECT *, CASE WHEN item % 7 = 0 THEN weight >= 2 AND t AND s >= 0.6 WHEN NOT coalesce(kind, true) OR item % 11 = 0 THEN s >= 0.8
    ELSE (weight >= 2 AND coalesce(c >= 0.25, true) AND (t OR s >= 0.45)) OR s >= 0.8 OR (t AND s >= 0.45) OR (t AND coalesce(kind, false) AND s >= 0.3) END AS sure FROM g)"""


@query(_SURE + " SELECT query_id, item, sure AS inject FROM sure")
def q66_gate(spark, d):
    return _judged(spark, d).select("query_id", "item", F.col("sure").alias("inject"))


@query(_SURE + """, pl AS (SELECT *, coalesce(min(CASE WHEN fused >= 0.95::DOUBLE * top AND kind THEN "order" END) OVER (PARTITION BY query_id), 1) AS place FROM (SELECT *, max(fused) OVER (PARTITION BY query_id) AS top FROM sure)),
  b AS (SELECT query_id, item AS chosen, fused AS bf, weight AS bw, family AS bfam, kind AS bk, sure AS bs FROM pl WHERE "order" = place)
  SELECT query_id, chosen, CASE WHEN NOT bs THEN 'not confident' WHEN bool_or(family <> bfam AND NOT coalesce(bk AND NOT kind, false) AND fused >= 0.95::DOUBLE * bf AND weight >= bw) THEN 'ambiguous' ELSE 'serve' END AS decision
  FROM pl JOIN b USING (query_id) GROUP BY query_id, chosen, bs""")
def q67_ambiguity(spark, d):
    return retrieval.decided(_judged(spark, d))


@query("""WITH need AS (SELECT l_orderkey AS procedure, l_linenumber AS pos, ['file', 'program', 'variable'][l_linenumber % 3 + 1] AS kind, l_partkey AS id FROM lineitem),
  have AS (SELECT 'file' AS kind, p_partkey AS id FROM part WHERE p_size > 10 UNION ALL SELECT 'program', p_partkey FROM part WHERE p_size > 30 UNION ALL SELECT 'variable', p_partkey FROM part WHERE p_size <= 25)
  SELECT procedure, arg_min(kind || ' ' || id, (pos, CAST(id AS VARCHAR))) AS unmet FROM need n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.kind = n.kind AND h.id = n.id) GROUP BY 1""")
def q68_preconditions(spark, d):
    kinds = F.element_at(F.array(F.lit("file"), F.lit("program"), F.lit("variable")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    need = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("procedure"), F.col("l_linenumber").alias("pos"), kinds.alias("kind"), F.col("l_partkey").cast("string").alias("name"), F.lit(None).cast("string").alias("within"))
    part = table(spark, d, "part").withColumn("name", F.col("p_partkey").cast("string"))
    files = part.where("p_size > 10").select(F.col("name").alias("path"), F.lit("").alias("text"))
    return retrieval.first_unmet(need, files, part.where("p_size > 30").select("name"), part.where("p_size <= 25").select("name"))
