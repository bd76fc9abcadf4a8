"""Hybrid retrieval: exact keys, BM25, sign-code and int8 vectors, reciprocal-rank fusion and a confidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators import nearest


def term_lists(docs: DataFrame, doc_id: str, title: Column, body: Column) -> DataFrame:
    """(doc_id, t, b, dl): the terms of title and body, and how many both have. Worth writing down: all stages read them."""
    both = docs.select(F.col(doc_id).alias("doc_id"), text.terms(title).alias("t"), text.terms(body).alias("b"))
    return both.withColumn("dl", F.size("t") + F.size("b"))


def postings(lists: DataFrame) -> DataFrame:
    """(term, doc_id, f, dl) of term_lists: title terms weigh two, body terms one."""
    weighed = F.concat(F.transform("t", lambda w: F.struct(w.alias("term"), F.lit(2).alias("w"))), F.transform("b", lambda w: F.struct(w.alias("term"), F.lit(1).alias("w"))))
    return lists.select("doc_id", "dl", F.explode(weighed).alias("x")).groupBy("doc_id", "dl", F.col("x.term").alias("term")).agg(F.sum("x.w").cast("double").alias("f"))


def key_weight(key: Column) -> Column:
    """What a shared key is worth: a path most, a symbol more than a word."""
    return F.when(F.contains(key, F.lit("/")), 2.0).when(key.rlike("[_.]"), 1.5).otherwise(1.0)


def exact_hits(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, item, hits, weight, rank) from distinct (item, key) and (query_id, key): the heaviest first, all of them."""
    found = keys.join(asked, "key").groupBy("query_id", "item").agg(F.count("*").alias("hits"), F.sum(key_weight(F.col("key"))).alias("weight"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "item")))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, query_id: str, prompt: Column, top: int = fixed.TOP_STAGE, budget: int = fixed.POSTINGS_BUDGET) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each query.

    index: from postings(); stats: one row (n, avgdl). A query's rarest terms come first while their documents are within the budget.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.posexplode(text.query_terms(prompt)).alias("pos", "term"))
    df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy("df", "pos")
    kept = asked.join(df, "term").withColumn("sum", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order)).where((F.col("sum") <= budget) | (F.col("nth") == 1))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = index.join(kept.select("query_id", "term", "df"), "term").crossJoin(F.broadcast(stats)).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def sign_code(vector: Column, dims: int) -> list[Column]:
    """Sign bits in words of 32."""
    return [F.aggregate(_bits(vector, a, min(a + 32, dims)), F.lit(0).cast("bigint"), lambda x, y: x + y) for a in range(0, dims, 32)]


def _bits(vector: Column, a: int, b: int) -> Column:
    return F.array(*[F.when(F.get(vector, F.lit(i)) >= 0, F.lit(1 << (i - a))).otherwise(F.lit(0)).cast("bigint") for i in range(a, b)])


def quantized(vector: Column) -> Column:
    """struct(scale, q): the largest component becomes 127."""
    scale = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))) / 127
    return F.struct(scale.alias("scale"), F.transform(vector, lambda x: F.round(x.cast("double") / scale).cast("int")).alias("q"))


def cosine(quantized: Column, vector: Column) -> Column:
    """The cosine of a quantized unit vector and a plain one."""
    return F.round(F.aggregate(F.zip_with(quantized["q"], vector, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda a, b: a + b) * quantized["scale"], 6)


def encoded(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, group, code, z): sign codes and quantized vectors of (vec_id, group, embedding)."""
    return vectors.select("vec_id", "group", F.array(*sign_code(F.col("embedding"), dims)).alias("code"), quantized(F.col("embedding")).alias("z"))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of each query by cosine, with their rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("rank") <= top)


def nearest_encoded(index: DataFrame, queries: DataFrame, dims: int, rescore: int = fixed.RESCORE, top: int = fixed.TOP_STAGE, parts: int | None = None) -> DataFrame:
    """vector_search over an index that is encoded already."""
    asked = queries.select("query_id", "group", F.array(*sign_code(F.col("embedding"), dims)).alias("code"), "embedding")
    near = nearest.nearest_codes(index, asked, rescore, parts).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("n") <= rescore)
    return ranked(near.select("query_id", "vec_id", "distance", F.round("cosine", 6).alias("cosine")), top)


def vector_search(index: DataFrame, queries: DataFrame, dims: int, rescore: int = fixed.RESCORE, top: int = fixed.TOP_STAGE, parts: int | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank): sign codes choose `rescore` vectors of the query's group, quantized cosines rank them.

    index: vec_id, group, embedding; queries: query_id, group, embedding. Groups are compared within themselves. A group's
    vectors are dealt to parts (`parts`, or as many as its size asks for), which choose on their own before the choices meet, so a large group is no single task.
    """
    return nearest_encoded(encoded(index, dims), queries, dims, rescore, top, parts)


def looked_up(pairs: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (query_id, item) with looked_up: the cosine of those whose vectors are in one group, null for others."""
    z = index.select(F.col("vec_id").alias("item"), F.col("group").alias("__g"), quantized(F.col("embedding")).alias("__z"))
    x = queries.select("query_id", F.col("group").alias("__h"), F.col("embedding").alias("__x"))
    found = pairs.join(z, "item", "left").join(x, "query_id", "left")
    return found.withColumn("looked_up", F.when(F.col("__g") == F.col("__h"), cosine(F.col("__z"), F.col("__x")))).drop("__g", "__h", "__z", "__x")


def fused(stages: list[DataFrame]) -> DataFrame:
    """(query_id, item, fused, order) of stages (query_id, item, rank): reciprocal ranks added up."""
    every = stages[0].select("query_id", "item", "rank")
    for s in stages[1:]:
        every = every.unionByName(s.select("query_id", "item", "rank"))
    total = every.groupBy("query_id", "item").agg(F.round(F.sum(1 / (F.col("rank") + fixed.RRF_K)), 12).alias("fused"))
    return total.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "item")))


def confident(state: Column, weight: Column, lexical_first: Column, ranked: Column, looked_up: Column, kind: Column, thing: Column) -> Column:
    """Whether a candidate's signals are enough to show it; kind and thing are true, false or null."""
    ranked = F.coalesce(ranked, F.lit(0.0))
    usual = ((weight >= 2) & (looked_up.isNull() | (looked_up >= fixed.FAINT)) & (lexical_first | (ranked >= fixed.STRONG))) | (ranked >= fixed.SURE) | (lexical_first & (ranked >= fixed.STRONG)) | (lexical_first & F.coalesce(kind, F.lit(False)) & (ranked >= fixed.FAIR))
    return F.when(state == "stale", (weight >= 2) & lexical_first & (ranked >= fixed.STALE)).when(~F.coalesce(kind, F.lit(True)) | ~F.coalesce(thing, F.lit(True)), ranked >= fixed.SURE).otherwise(usual)


def decided(candidates: DataFrame) -> DataFrame:
    """(query_id, chosen, decision) from candidates (query_id, item, fused, order, weight, family, kind, sure).

    Of those within 95 % of the first, the first of the same kind is chosen, else the first. It is shown if it is sure and no
    candidate of another family comes within 95 % of it with as much weight, but for those of another kind where the chosen's is the same.
    """
    own = Window.partitionBy("query_id")
    close = F.col("fused") >= 0.95 * F.max("fused").over(own)
    rows = candidates.withColumn("__pick", F.when(close & F.coalesce(F.col("kind"), F.lit(False)), F.col("order")))
    rows = rows.withColumn("__at", F.coalesce(F.min("__pick").over(own), F.lit(1)))
    rows = rows.withColumn("__best", F.max(F.when(F.col("order") == F.col("__at"), F.struct("item", "fused", "weight", "family", "kind", "sure"))).over(own))
    other_kind = F.coalesce(F.col("__best.kind") & ~F.col("kind"), F.lit(False))
    rival = (F.col("family") != F.col("__best.family")) & ~other_kind & (F.col("fused") >= 0.95 * F.col("__best.fused")) & (F.col("weight") >= F.col("__best.weight"))
    out = rows.groupBy("query_id").agg(F.first("__best.item").alias("chosen"), F.first("__best.sure").alias("__sure"), F.max(rival).alias("__rival"))
    return out.select("query_id", "chosen", F.when(~F.col("__sure"), "not confident").when(F.col("__rival"), "ambiguous").otherwise("serve").alias("decision"))


def first_unmet(conditions: DataFrame, files: DataFrame, programs: DataFrame, variables: DataFrame) -> DataFrame:
    """(procedure, unmet): the first condition, by pos, that a workspace doesn't meet.

    conditions: procedure, pos, kind (file, symbol, program, variable), name, within (a symbol's file). files: path, text; programs and
    variables: name. Conditions of all kinds meet what there is by equi-joins.
    """
    have = files.select(F.lit("file").alias("kind"), F.col("path").alias("name")).unionByName(programs.select(F.lit("program").alias("kind"), "name")).unionByName(variables.select(F.lit("variable").alias("kind"), "name")).distinct()
    open_ = conditions.join(have.withColumn("__met", F.lit(True)), ["kind", "name"], "left")
    text_of = files.select(F.col("path").alias("within"), F.col("text").alias("__text"))
    symbols = open_.where("kind = 'symbol'").join(text_of, "within", "left").withColumn("__met", F.contains("__text", "name")).drop("__text")
    every = open_.where("kind <> 'symbol'").unionByName(symbols.select(*open_.columns)).where(~F.coalesce("__met", F.lit(False)))
    return every.groupBy("procedure").agg(F.min_by(F.concat_ws(" ", "kind", "name"), F.struct("pos", "name")).alias("unmet"))
