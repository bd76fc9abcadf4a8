"""Checks that a project declares in its documents, scripts and build files, and which of them is the strongest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import fixed, shell, text


def declared_commands(files: DataFrame) -> DataFrame:
    """(repo, stage, at, command, source): what files (repo, path, text) offer as commands, in order of discovery."""
    path, body = F.col("path"), F.col("text")

    def found(stage: int, rows: DataFrame, commands) -> DataFrame:
        return rows.select("repo", F.lit(stage).alias("stage"), F.posexplode(commands).alias("at", "command"), path.alias("source"))

    stages = [found(n, files.where(path == doc), text.doc_code(body)) for n, doc in enumerate(fixed.CHECK_DOCS)]
    nth = len(stages)

    locks = F.create_map(*(F.lit(x) for pair in fixed.LOCKFILES.items() for x in pair))
    order = F.array_position(F.array(*map(F.lit, fixed.LOCKFILES)), path)
    managers = files.where(path.isin(*fixed.LOCKFILES)).groupBy("repo").agg(F.min_by(locks[path], order).alias("manager"))
    package = files.where(path == "package.json").join(managers, "repo", "left").withColumn("j", F.try_parse_json(body)).withColumn("m", F.coalesce("manager", F.lit("npm")))
    script = lambda name: F.try_variant_get("j", f"$.scripts.{name}", "string")
    runs = [F.when(script(n).isNotNull() & ~F.contains(script(n), F.lit("Error: no test specified")), F.concat("m", F.lit(" test" if n == "test" else f" run {n}"))) for n in fixed.PACKAGE_SCRIPTS]
    stages.append(found(nth, package, F.filter(F.array(*runs), lambda x: x.isNotNull())))

    for n, (name, runner) in enumerate((("Makefile", "make"), ("justfile", "just"), ("Justfile", "just"))):
        rows = files.where(path == name).withColumn("__run", F.lit(f"{runner} "))
        stages.append(found(nth + 1 + n, rows, F.transform(F.regexp_extract_all(body, F.lit(fixed.MAKE_TARGET), F.lit(1)), lambda t: F.concat("__run", t))))
    whole = {**fixed.CHECK_SCRIPTS, "Cargo.toml": "cargo test", "go.mod": "go test ./..."}
    stages += [found(nth + 4 + n, files.where(path == name), F.array(F.lit(command))) for n, (name, command) in enumerate(whole.items())]
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def declared_checks(files: DataFrame) -> DataFrame:
    """(repo, command, source, strength, words, place): declared commands that are single plain harmless checks, each once by its words.

    place orders a repository's checks: the strongest first, then as found.
    """
    commands = declared_commands(files).withColumn("command", text.trimmed(F.col("command"))).where(~F.col("command").rlike(r"[\n\r;&|`$<>()]") & text.danger(F.col("command")).isNull())
    checks = commands.withColumn("c", shell.analysis(F.col("command"))).where("c.is_check")
    place = F.struct("stage", "at")
    once = checks.groupBy("repo", F.col("c.words").alias("words")).agg(F.min_by(F.struct("command", "source", F.col("c.strength").alias("strength")), place).alias("r"), F.min(place).alias("p"))
    w = Window.partitionBy("repo").orderBy(F.desc("r.strength"), "p")
    return once.select("repo", "words", "r.*", F.row_number().over(w).alias("place"))
