"""Unified diffs to changed lines: split into files, then hunks, then counted line by line inside each hunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import absolute
from factloom.sources.readers import revision_diff


def diff_texts(spark, kind: str, value: str, repository: str = ".") -> DataFrame:
    """(text) from a string, a file or folder of files, a table that holds it (`table`, column text), the revisions `base...head` or `base` (against HEAD) of a repository (`revision`),
    or a merge request's changes as its interface gives them, saved as JSON (`api`: a file or folder)."""
    if kind == "auto":
        kind = "string" if "diff --git " in value else "file"
    if kind == "string":
        return spark.createDataFrame([(value,)], "text string")
    if kind == "file":
        return spark.read.text(value, wholetext=True).select(F.col("value").alias("text"))
    if kind == "table":
        return spark.read.parquet(value).select("text")
    if kind == "revision":
        base, _, head = value.partition("...")
        return revision_diff(spark, repository, base, head or "HEAD")
    if kind == "api":
        return _of_api(merge_request_changes(spark, value))
    raise ValueError(f"unknown diff source: {kind}")


def blocks(diffs: DataFrame) -> DataFrame:
    """(diff, block, path, old_path, text) for every file of a diff; path is the new one, or the old where there is no other."""
    # A diff is named by its hash, so that equal diffs count once and no whole text is compared.
    d = diffs.where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("diff"), F.regexp_replace("text", "\r\n", "\n").alias("text")).dropDuplicates(["diff"])
    parts = d.select("diff", F.posexplode(F.split("text", r"(?m)^diff --git ")).alias("block", "text")).where("block > 0")
    head = F.substring_index("text", "\n", 1)
    new = F.nullif(F.regexp_extract(head, r" b/(.+)$", 1), F.lit(""))
    old = F.nullif(F.regexp_extract(head, r"^a/(.+?)(?: b/|$)", 1), F.lit(""))
    return parts.select("diff", "block", F.coalesce(new, old).alias("path"), old.alias("old_path"), "text")


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(path, line) of added lines that are not blank; binary files give line 0. diffs: (text). No window is larger than a hunk."""
    every = blocks(diffs)
    hunks = every.select("diff", "block", "path", F.posexplode(F.split("text", r"(?m)^(?=@@ )")).alias("hunk", "text")).where("hunk > 0")
    start = F.regexp_extract("text", r"^@@ [^+\n]*\+(\d+)", 1).cast("int")
    rows = hunks.where(F.regexp_extract("text", r"^@@ [^+\n]*\+(\d+)", 1) != "").select("diff", "block", "hunk", "path", start.alias("start"), F.posexplode(F.split("text", "\n")).alias("at", "row")).where("at > 0")
    counted = (~F.col("row").startswith("-") & ~F.col("row").startswith("\\")).cast("int")
    before = Window.partitionBy("diff", "block", "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line", F.col("start") + F.sum(counted).over(before) - 1)
    added = rows.where(F.col("row").startswith("+") & (F.trim(F.substring("row", 2, 1 << 30)) != "")).select("path", F.col("line").cast("int").alias("line"))
    binary = every.where(F.col("text").rlike(r"(?m)^(Binary files |GIT binary patch)")).select("path", F.lit(0).alias("line"))
    return added.union(binary).distinct()


def merge_request_changes(spark, path: str) -> DataFrame:
    """(iid, old_path, new_path, diff) of merge requests saved as JSON: an object with `changes`, or a list of changes, a file each."""
    entry = "struct<old_path string, new_path string, diff string, new_file boolean, deleted_file boolean>"
    texts = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"struct<iid bigint, changes array<{entry}>>")
    rows = texts.select(F.when(F.col("value").rlike(r"^\s*\["), F.struct(F.lit(None).cast("bigint").alias("iid"), F.from_json("value", f"array<{entry}>").alias("changes"))).otherwise(whole).alias("m"))
    return rows.select("m.iid", F.explode("m.changes").alias("c")).select("iid", "c.old_path", "c.new_path", "c.diff")


def _of_api(entries: DataFrame) -> DataFrame:
    """(text) of entries (new_path, diff), whose hunks have no head."""
    return entries.select(F.concat(F.lit("diff --git a/"), F.coalesce("old_path", "new_path") if "old_path" in entries.columns else F.col("new_path"), F.lit(" b/"), "new_path", F.lit("\n"), F.coalesce("diff", F.lit(""))).alias("text"))


def changed_lines_of_api(entries: DataFrame) -> DataFrame:
    """changed_lines() of entries (new_path, diff) as a merge-request interface gives them."""
    return changed_lines(_of_api(entries))


def changed_files(diffs: DataFrame) -> DataFrame:
    """(path): the old paths of all files that the diffs touch."""
    return blocks(diffs).select(F.coalesce("old_path", "path").alias("path")).distinct()


def under_root(changed: DataFrame, root: str) -> DataFrame:
    """changed with absolute paths."""
    return changed.withColumn("path", absolute(F.col("path"), root))
