"""Reports of impact analyses as rows that read from top to bottom, and their totals; every row comes from a join or group, so that a report of any length stays a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import impact
from factloom.sources import code_facts
from factloom.tables import durable

_LINE = ["section", "name", "nth", "line"]


def impact_report(facts, changed: DataFrame, max_depth: int = 6) -> DataFrame:
    """(part, path, level, symbols, way): `changed` files with their changed symbols, and `impact` files with the level at which a change reaches them and one shortest way to them."""
    hit = impact.changed_symbols(facts, changed).groupBy("path").agg(F.count("*").alias("symbols"))
    given = changed.select("path").distinct().join(hit, "path", "left").select(F.lit("changed").alias("part"), "path", F.lit(0).alias("level"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.lit(None).cast("string").alias("way"))
    reached = impact.file_impact(facts, changed, max_depth).join(impact.file_impact_paths(facts, changed, max_depth).select("path", "way"), "path", "left")
    return given.unionByName(reached.select(F.lit("impact").alias("part"), "path", "level", "symbols", "way"))


def impact_totals(facts, report: DataFrame) -> DataFrame:
    """One row: files of the project, changed ones, and those that the changes reach."""
    count = lambda p: F.count(F.when(F.col("part") == p, 1)).alias(f"{p}_files")
    return code_facts.code_files(facts["files"]).agg(F.count("*").alias("files")).crossJoin(report.agg(count("changed"), count("impact")))


def mr_report(classified: DataFrame, impacts: DataFrame) -> DataFrame:
    """(section, name, nth, line) of classified files (path, category, name) and impacts (source, component, relation, level, way), to be read in this order: 1 what to test and why, 2 changed
    components, 3 changed functions, 4 other files, 5 a summary."""
    classified, impacts = durable(classified, "classified"), durable(impacts, "impacts")
    own = classified.where("category = 'component'").select(F.col("name").alias("component")).distinct()
    reasons = own.select("component", F.lit(0).alias("level"), F.lit("").alias("source"), F.lit("changed itself").alias("why")).unionByName(
        impacts.select("component", "level", "source", F.when(F.col("way").isNull(), F.concat(F.lit("depends on "), "source")).otherwise(F.concat(F.lit("through "), "way")).alias("why"))
    )
    title = lambda df, section, column="name": df.select(F.lit(section).alias("section"), F.col(column).alias("name"), F.struct(F.lit(-1).alias("level"), F.lit("").alias("by")).alias("nth"), F.concat(F.lit("• "), F.col(column)).alias("line")).distinct()
    lines = title(reasons, 1, "component").unionByName(reasons.select(F.lit(1).alias("section"), F.col("component").alias("name"), F.struct("level", F.col("source").alias("by")).alias("nth"), F.concat(F.lit("  - "), "why").alias("line")))
    for section, category in ((2, "component"), (3, "functions")):
        rows = classified.where(F.col("category") == category)
        lines = lines.unionByName(title(rows, section)).unionByName(rows.select(F.lit(section).alias("section"), "name", F.struct(F.lit(0).alias("level"), F.col("path").alias("by")).alias("nth"), F.concat(F.lit("  - "), "path").alias("line")))
    lines = lines.unionByName(classified.where("category = 'other'").select(F.lit(4).alias("section"), F.lit("").alias("name"), F.struct(F.lit(0).alias("level"), F.col("path").alias("by")).alias("nth"), F.concat(F.lit("- "), "path").alias("line")))
    totals = reasons.agg(F.count_distinct("component").alias("n"), F.count_distinct(F.when(F.col("level") == 0, F.col("component"))).alias("m"))
    summary = totals.select(F.lit(5).alias("section"), F.lit("").alias("name"), F.struct(F.lit(0).alias("level"), F.lit("").alias("by")).alias("nth"), F.format_string("%d components affected, %d of them changed directly", "n", "m").alias("line"))
    return lines.unionByName(summary).select(*_LINE)


def in_order(report: DataFrame) -> DataFrame:
    """(line) of a report, top to bottom."""
    return report.orderBy("section", "name", "nth").select("line")
