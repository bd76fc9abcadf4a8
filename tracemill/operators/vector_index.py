"""Sign codes and quantized vectors kept as a table, partitioned by a hash of their group (a repository).

A refresh encodes only what is new or changed and rewrites only the partitions that it touches; a search reads only those of its
queries' groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import fixed
from tracemill.operators import retrieval
from tracemill.tables import durable

OVERFETCH = 5  # times as many neighbors as asked for, before those that may not be shown go


class VectorIndex:
    """The table at a path: vec_id, group, digest (of the vector), code, z and bucket."""

    def __init__(self, spark: SparkSession, path: str, dims: int, buckets: int = 64):
        self.spark, self.path, self.dims, self.buckets = spark, path.rstrip("/"), dims, buckets

    def _folder(self, name: str = ""):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bucket(self, group):
        return F.pmod(F.xxhash64(group), F.lit(self.buckets)).cast("int")

    def _marked(self, vectors: DataFrame) -> DataFrame:
        return vectors.select("vec_id", "group", F.xxhash64("embedding", F.size("embedding")).alias("digest"), self._bucket(F.col("group")).alias("bucket"))

    def read(self, like: DataFrame) -> DataFrame:
        """The table; like: vectors as they are handed to refresh, for the types of an index that isn't there yet."""
        empty = retrieval.encoded(like.limit(0), self.dims).select("vec_id", "group", F.lit(0).cast("bigint").alias("digest"), "code", "z", F.lit(0).alias("bucket"))
        folder, files = self._folder()
        if not files.exists(folder) or not any(s.isDirectory() for s in files.listStatus(folder)):
            return empty.where("false")
        return self.spark.read.schema(empty.schema).parquet(self.path)

    def refresh(self, vectors: DataFrame) -> int:
        """Makes the table hold these vectors (vec_id, group, embedding), one for each vec_id; how many had to be encoded."""
        now, old = self._marked(vectors), self.read(vectors)
        was = old.select("vec_id", F.col("group").alias("__g"), F.col("digest").alias("__d"), F.col("bucket").alias("__b"))
        both = now.join(was, "vec_id", "full")
        moved = durable(both.where(~(F.col("group").eqNullSafe(F.col("__g")) & F.col("digest").eqNullSafe(F.col("__d")))).select("vec_id", "bucket", "__b"), "moved")
        touched = sorted(r[0] for r in moved.select(F.explode(F.array("bucket", "__b")).alias("b")).where("b IS NOT NULL").distinct().collect())  # at most `buckets`
        if not touched:
            return 0
        fresh = retrieval.encoded(vectors.join(moved.where("bucket IS NOT NULL").select("vec_id"), "vec_id", "left_semi"), self.dims)
        marks = now.select("vec_id", "digest", "bucket")
        fresh = fresh.join(marks, "vec_id").select("vec_id", "group", "digest", "code", "z", "bucket")
        kept = old.where(F.col("bucket").isin(*touched)).join(moved.select("vec_id"), "vec_id", "left_anti").select(*fresh.columns)
        rows = durable(kept.unionByName(fresh), "vectors")
        left = {r[0] for r in rows.select("bucket").distinct().collect()}
        for bucket in set(touched) - left:
            folder, files = self._folder(f"bucket={bucket}")
            files.delete(folder, True)
        rows.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(self.path)
        return moved.where("bucket IS NOT NULL").count()

    def search(self, queries: DataFrame, shown: DataFrame | None = None, top: int = fixed.TOP_STAGE, rescore: int = fixed.RESCORE) -> DataFrame:
        """(query_id, vec_id, distance, cosine, rank) of queries (query_id, group, embedding); shown: vec_id of those that may be."""
        own = sorted(r[0] for r in queries.select(self._bucket(F.col("group")).alias("b")).distinct().collect())  # at most `buckets`
        like = queries.select(F.col("query_id").alias("vec_id"), "group", "embedding")
        rows = self.read(like).where(F.col("bucket").isin(*own)).select("vec_id", "group", "code", "z")
        if shown is None:
            return retrieval.nearest_encoded(rows, queries, self.dims, rescore, top)
        found = retrieval.nearest_encoded(rows, queries, self.dims, rescore, top * OVERFETCH).join(shown.select("vec_id"), "vec_id", "left_semi")
        return retrieval.ranked(found, top)
