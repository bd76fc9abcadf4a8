"""Mixing sources to target weights by capped water-filling, DataFrame functions only.

Every source gets a share of `budget` times all words by weight, but no more than `max_epochs`
times its own words; what is over goes to the others by weight, until none is above. In order
of cap by weight, sources fill up one after another, so running sums over the (few) sources
give the final water level without iterating.

A source's target is met with whole repetitions of each document and, for the rest, one more of
those that come first in a seeded order, until the words are had. The running sum behind this
runs in two steps, over buckets of the order and within one bucket, so that a source with a
third of all rows is spread over `buckets` groups.

Cases: a null or empty text has size 0 and takes none; a null source is a source of its own,
last in order; repeated rows count as often as they occur, and which of several rows alike in id
and size is taken depends on their texts; an empty table gives an empty result. Further columns, whatever
their names, pass through `mix` and are ignored by `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import WORD

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(__s, source_size, target) from (__s, __size); __s is the source's name with a leading mark that sorts nulls last."""
    sources = sizes.groupBy("__s").agg(F.sum("__size").alias("source_size"))
    by_name, by_fill, every = Window.orderBy("__s"), Window.orderBy("__fill", "__s"), Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(by_name) - 1
    filled = (
        sources.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(nth, F.lit(len(weights))) + 1).cast("double"))
        .withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("__fill", F.col("__cap") / F.col("__w"))
        .withColumn("__all", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("__rest", F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__level", F.col("__rest") / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
        .withColumn("__n", F.row_number().over(by_fill))
        .withColumn("__water", F.min(F.when(F.col("__fill") > F.col("__level"), F.struct("__n", "__level"))).over(every)["__level"])
    )
    under = F.col("__fill") > F.col("__water")
    return filled.select("__s", "source_size", F.when(under, F.col("__water") * F.col("__w")).otherwise(F.col("__cap")).alias("target"))


def _planned(docs: DataFrame, id_col, text_col, source_col, weights, budget, max_epochs, seed, buckets) -> DataFrame:
    """Internal columns __s, __bucket, __size, __source_size, __target and __reps beside docs', whose names they must not have."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = (
        docs.withColumn("__size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("__s", F.coalesce(F.concat(F.lit("a"), F.col(source_col)), F.lit("b")))
        .withColumn("__order", order)
        .withColumn("__tie", F.xxhash64(text_col))
        .withColumn("__bucket", F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") % buckets)
    )
    groups = rows.groupBy("__s", "__bucket").agg(F.sum("__size").alias("__size"))
    targets = source_targets(groups, weights, budget, max_epochs).withColumnsRenamed({"source_size": "__source_size", "target": "__target"})
    earlier = Window.partitionBy("__s").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        groups.withColumn("__base", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .drop("__size")
        .join(targets, "__s")
        .withColumn("__whole", F.when(F.col("__source_size") > 0, F.floor(F.try_divide(F.col("__target"), F.col("__source_size")))).otherwise(0))
        .withColumn("__quota", F.col("__target") - F.col("__whole") * F.col("__source_size"))
    )
    inside = Window.partitionBy("__s", "__bucket").orderBy("__order", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__base") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    more = (F.col("__whole") < max_epochs) & (start + F.col("__size") / 2 <= F.col("__quota"))
    return rows.join(quotas, ["__s", "__bucket"]).withColumn("__reps", F.col("__whole").cast("int") + F.when(more, 1).otherwise(0))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, budget: float = 1.5, max_epochs: int = 2, seed: int = 7, buckets: int = 4096) -> DataFrame:
    """Per row: id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    planned = _planned(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, weights, budget, max_epochs, seed, buckets)
    return planned.select(id_col, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__reps")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, budget: float = 1.5, max_epochs: int = 2, seed: int = 7, buckets: int = 4096) -> DataFrame:
    """The mix itself: each row of docs as often as the plan takes it."""
    # docs' columns travel under numbers, so none of their names can clash
    columns = docs.columns
    numbered = docs.toDF(*(f"c{n}" for n in range(len(columns))))
    at = {c: f"c{n}" for n, c in enumerate(columns)}
    planned = _planned(numbered, at[id_col], at[text_col], at[source_col], weights, budget, max_epochs, seed, buckets)
    repeated = planned.where("__reps > 0").select(*numbered.columns, F.explode(F.array_repeat(F.lit(1), F.col("__reps"))).alias("__one"))
    return repeated.drop("__one").toDF(*columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
o AS (SELECT *, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 4096 AS b FROM d),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM o GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][nth % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / w AS fill,
             (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
             row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS n
      FROM w),
l AS (SELECT (SELECT level FROM f WHERE fill > level ORDER BY n LIMIT 1) AS water),
t AS (SELECT f.source, f.source_size, CASE WHEN fill > water THEN water * w ELSE cap END AS target FROM f, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT o.doc_id, o.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS quota,
             coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY o.b, o.h, o.size, hash(o.doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN whole < 2 AND start + size / 2 <= quota THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
