"""Where work happened: project roots of directories, identities of repositories, and the commit that was checked out at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import fixed, text

SALTS = 32


def normalized_remote(url: Column) -> Column:
    """host/path of a remote in any spelling: without scheme, user, port, outer slashes and .git; the host in lower case. Null for null."""
    url = text.trimmed(url)
    scheme = F.instr(url, "://") > 0
    short = ~scheme & url.rlike(r"^[^/:]*:")
    rest = F.when(scheme, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(url)
    authority = F.when(scheme, F.regexp_extract(rest, r"(?s)^[^/]*", 0)).when(short, F.regexp_extract(rest, r"(?s)^[^:]*", 0)).otherwise("")
    path = F.when(scheme, F.regexp_replace(rest, r"(?s)^[^/]*/?", "")).when(short, F.regexp_replace(rest, r"(?s)^[^:]*:", "")).otherwise(rest)
    host = F.regexp_replace(F.regexp_replace(authority, r"(?s)^.*@", ""), r"(?s):.*$", "")
    path = F.rtrim(F.regexp_replace(F.trim(path, F.lit("/")), r"\.git$", ""), F.lit("/"))
    return F.concat(F.lower(host), F.lit("/"), path)


def fnv64(value: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, as 16 hexadecimal digits. Kept as two halves of 32 bits, so that no product overflows."""
    half = 0xFFFFFFFF
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda b: F.conv(b, 16, 10).cast("bigint"))

    def step(s: Column, byte: Column) -> Column:
        low = s["low"].bitwiseXOR(byte)
        product = low * 0x1B3
        high = s["high"] * 0x1B3 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(half).alias("high"), product.bitwiseAND(half).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("high"), F.lit(0x84222325).cast("bigint").alias("low"))
    shown = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(codes, start, step, lambda s: F.concat(shown(s["high"]), shown(s["low"])))


def _above(path: Column) -> Column:
    """A directory and all above it, nearest first; the root directory is /."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def project_roots(directories: DataFrame, files: DataFrame, home: str | None = None) -> DataFrame:
    """(cwd, root): the nearest directory at or above cwd with .git, else with another version control, else with a manifest (but not /), else cwd itself.

    directories: cwd, any number of times; files: dir, name. Below home, directories at or above home don't count. One equi-join on
    the directory; only marker files are joined, and each distinct cwd gives as many rows as its path has parts. All of them share
    the upper directories, so both sides are salted: markers, one row a directory, are repeated SALTS times.
    """
    kinds = {1: (".git",), 2: fixed.VERSION_CONTROL, 3: fixed.MANIFESTS}
    rank = F.coalesce(*(F.when(F.col("name").isin(*names), F.lit(n)) for n, names in kinds.items()))
    markers = files.select(F.col("dir").alias("__dir"), rank.alias("__rank")).where("__rank IS NOT NULL").groupBy("__dir").agg(F.collect_set("__rank").alias("__ranks"))
    markers = markers.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cwds = directories.select("cwd").where("cwd IS NOT NULL").distinct()
    rows = cwds.select("cwd", F.pmod(F.xxhash64("cwd"), F.lit(SALTS)).cast("int").alias("__salt"), F.posexplode(_above(F.col("cwd"))).alias("__far", "__dir"))
    if home is not None:
        home = home.rstrip("/")
        below = F.col("cwd").startswith(home + "/")
        rows = rows.where(~below | F.col("__dir").startswith(home + "/"))
    found = rows.join(markers, ["__dir", "__salt"]).select("cwd", "__dir", "__far", F.explode("__ranks").alias("__rank")).where("__rank < 3 OR __dir <> '/'")
    best = found.groupBy("cwd").agg(F.min_by("__dir", F.struct("__rank", "__far")).alias("root"))
    return cwds.join(best, "cwd", "left").select("cwd", F.coalesce("root", "cwd").alias("root"))


def repository_ids(roots: DataFrame, first_commits: DataFrame, remotes: DataFrame) -> DataFrame:
    """(root, repo): the smallest commit without parents; of a shallow clone a hash of its remote; else a hash of its path.

    roots: root, has_head, shallow; first_commits: root, commit (what the log lists without parents); remotes: root, name, place, url. Of
    remotes, origin counts before the first by place. Copies of one repository in several places get one id, which is what joins them.
    """
    smallest = first_commits.withColumn("__commit", text.trimmed(F.col("commit"))).where("__commit <> ''").groupBy("root").agg(F.min("__commit").alias("__commit"))
    chosen = remotes.groupBy("root").agg(F.min_by("url", F.struct(F.col("name") != "origin", "place")).alias("__url"))
    rows = roots.select("root", "has_head", "shallow").join(smallest, "root", "left").join(chosen, "root", "left")
    remote = F.concat(F.lit("remote-"), fnv64(normalized_remote(F.col("__url"))))
    by_path = F.concat(F.lit("path-"), fnv64(F.col("root")))
    return rows.select("root", F.coalesce(F.when(F.col("has_head"), F.when(F.col("shallow"), remote).otherwise(F.col("__commit"))), by_path).alias("repo"))


def commit_at(moments: DataFrame, reflog: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """moments with head: the commit that a repository's reflog shows for the moment; null before its first entry.

    moments: root, at, more; reflog: root, at, place (0 is the newest entry), commit. The first entry in the log's order counts whose time is
    not later than the moment: clocks may go back. An as-of join: both sides are dealt by root and block of time, so that a busy root
    spreads; what earlier blocks hold comes from one row a block.
    """
    names = moments.columns
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    block = F.floor(micros / (block_seconds * 1_000_000)).alias("__block")
    entry = F.struct("place", "commit")
    left = moments.select(F.col("root").alias("__root"), block, micros.alias("__at"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.lit(None).cast("struct<place: bigint, commit: string>").alias("__entry"))
    entries = reflog.where("at IS NOT NULL").withColumn("place", F.col("place").cast("bigint")).select(F.col("root").alias("__root"), block, micros.alias("__at"), entry.alias("__entry"))
    blocks = entries.groupBy("__root", "__block").agg(F.min("__entry").alias("__first"))
    marks = blocks.unionByName(left.select("__root", "__block").distinct(), allowMissingColumns=True).groupBy("__root", "__block").agg(F.min("__first").alias("__first"))
    before = Window.partitionBy("__root").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = marks.select("__root", "__block", F.min("__first").over(before).alias("__earlier"))
    inside = Window.partitionBy("__root", "__block").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = left.unionByName(entries, allowMissingColumns=True).withColumn("__inner", F.min("__entry").over(inside)).where("__row IS NOT NULL")
    rows = rows.join(earlier, (rows["__block"] == earlier["__block"]) & rows["__root"].eqNullSafe(earlier["__root"]), "left")
    return rows.select("__row.*", F.least("__inner", "__earlier")["commit"].alias("head"))
