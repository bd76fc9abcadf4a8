"""Chat formatting with cumulative-snapshot collapse, DataFrame functions only.

Chat logs often hold one conversation many times, each time with some more turns. A rolling hash
over a conversation's turns gives each prefix a 128-bit name; a conversation whose name as a whole
is also a proper prefix of another goes (anti-join), as do all but the smallest id of equal
ones. What is left is rendered.

The prefix names are combined to one row a name before they are joined, so that a first turn or a
conversation that very many logs share is one row on either side.

Cases: rows alike in all four columns count once; turns go by number, then role, then text; a
null role reads as 'unknown', a null text as empty, and turns without a conversation id form one
conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(__c, id, __n, __role, __text, __a, __b, __len): numbered turns with the hashes of the prefix that ends there."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("c"), F.col(id_col).cast("string")), F.lit("n")).alias("__c"),
        F.col(id_col).alias("__id"),
        F.col("turn").alias("__turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("__role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"),
    ).distinct()
    order = Window.partitionBy("__c").orderBy("__turn", "__role", "__text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("__n", F.row_number().over(order))
        .withColumn("__a", F.bit_xor(F.xxhash64(F.lit(1), "__n", "__role", "__text")).over(so_far))
        .withColumn("__b", F.bit_xor(F.xxhash64(F.lit(2), "__n", "__role", "__text")).over(so_far))
        .withColumn("__len", F.count("*").over(Window.partitionBy("__c")))
    )


def maximal(rows: DataFrame) -> DataFrame:
    """(__c, __copies): conversations that prefix no longer one, one for each group of equal ones."""
    name = ["__n", "__a", "__b"]
    prefixes = rows.where("__n < __len").select(*name).distinct()
    whole = rows.where("__n = __len").groupBy(*name).agg(F.min(F.struct("__id", "__c")).alias("__first"), F.count("*").alias("__copies"))
    return whole.join(prefixes, name, "left_anti").select(F.col("__first.__c").alias("__c"), "__copies")


def format_chats(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation kept: id, n_turns, n_copies (equal logs), chat (rendered with turn markers)."""
    rows = turns(conversations, id_col)
    kept = maximal(rows)
    body = F.replace(F.col("__text"), F.lit("<|"), F.lit("< |"))
    piece = F.concat(F.lit("<|im_start|>"), F.replace(F.col("__role"), F.lit("<|"), F.lit("< |")), F.lit("\n"), body, F.lit("<|im_end|>\n"))
    return (
        rows.select("__c", "__id", F.struct(F.col("__n").alias("n"), piece.alias("p")).alias("__turn"))
        .join(kept, "__c")
        .groupBy("__c", "__id", "__copies")
        .agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
        .select(
            F.col("__id").alias(id_col),
            F.size("__turns").cast("long").alias("n_turns"),
            F.col("__copies").alias("n_copies"),
            F.array_join(F.transform("__turns", lambda t: t["p"]), "").alias("chat"),
        )
    )


ORACLE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(role || chr(31) || text ORDER BY turn, role, text) AS l,
             string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
      FROM t GROUP BY conv_id),
g AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n, l, any_value(chat) AS chat FROM c GROUP BY l),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, n)) AS i FROM g))
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, n_copies, chat FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = g.l)
"""
