"""Lines of a JSON log whose records were broken at line ends within strings, put together again.

A record that doesn't parse is joined with the lines behind it until it does, MOST_LINES at most and not beyond a line that opens a record
itself. Only stretches that hold such a record leave generated code.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_LINES = 64


def _is_record(line: str) -> bool:
    try:
        found = json.loads(line)
    except ValueError:
        return False
    return isinstance(found, dict) and isinstance(found.get("type"), str)


def joined(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(line, record): the records of some lines; one that was put together has the number of its last line."""
    out, pending, more = [], "", 0
    for number, line in lines:
        if pending:
            pending, more = f"{pending}\\n{line}", more + 1
            if _is_record(pending):
                out.append((number, pending))
                pending = ""
                continue
            if not line.startswith('{"') and more <= MOST_LINES:
                continue
            pending = ""
        if _is_record(line):
            out.append((number, line))
        elif line.startswith("{"):
            pending, more = line, 0
    return out


def _mended(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["line"].to_pylist(), table["value"].to_pylist(), strict=True))
    found = joined(rows)
    return pa.table({"file": pa.array([table["file"][0].as_py()] * len(found), pa.string()), "line": pa.array([n for n, _ in found], pa.int32()), "value": pa.array([v for _, v in found], pa.string())})


def rejoined(lines: DataFrame) -> DataFrame:
    """(file, line, value): the records of logs whose lines may be broken; lines that belong to no record go."""
    rows = lines.where("value IS NOT NULL").withColumn("__j", F.try_parse_json("value"))
    whole = F.schema_of_variant("__j").startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get("__j", "$.type", "variant")) == "STRING")
    rows = rows.select("file", F.col("line").cast("int").alias("line"), F.col("value").cast("string").alias("value"), F.coalesce(whole, F.lit(False)).alias("__whole"))
    opens = F.startswith("value", F.lit('{"'))
    rows = rows.withColumn("__stretch", F.sum(opens.cast("int")).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    broken = F.max(F.startswith("value", F.lit("{")) & ~F.col("__whole")).over(Window.partitionBy("file", "__stretch"))
    rows = rows.withColumn("__broken", broken)
    fine = rows.where("NOT __broken AND __whole").select("file", "line", "value")
    return fine.unionByName(rows.where("__broken").groupBy("file", "__stretch").applyInArrow(_mended, "file string, line int, value string"))
