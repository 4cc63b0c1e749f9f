"""What a change reaches: symbols, files, components, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import in_folder
from factloom.operators import graph
from factloom.operators.analyzers import changed_symbols, component_edges, component_of, file_edges
from factloom.tables import durable


def affected_names(facts, changed: DataFrame) -> DataFrame:
    """(src_path, import_module): the names by which other files can import what changed: changed exports where they are declared, and every re-export of them."""
    hit = durable(changed_symbols(facts, changed).where("exported").select("path", "name"), "changed-symbols")
    # The name outside is that of the export: an alias in a braces list, or default.
    shown = facts["exports"].join(hit.withColumnRenamed("name", "local_name"), ["path", "local_name"], "left_semi").select("path", "name")
    via = facts["origins"].join(shown.toDF("origin_path", "origin_name"), ["origin_path", "origin_name"])
    return durable(via.select(F.col("path").alias("src_path"), F.col("name").alias("import_module")).distinct(), "affected-names")


def direct_importers(facts, changed: DataFrame) -> DataFrame:
    """(path, name, import_type): files that import what changed. Named imports meet names, defaults the default, namespaces and side effects the file; a changed file without symbols is met by all who import it."""
    named = affected_names(facts, changed)
    imports = facts["imports"].where("src_type = 'file'")
    fits = F.when(F.col("module_type").isin("default", "dynamic", "dynamic_variable"), F.col("import_module") == "default").otherwise(F.col("module_type") == "named")
    direct = imports.join(named, ["src_path", "import_module"]).where(fits).select("path", F.col("import_module").alias("name"), F.col("module_type").alias("import_type"))
    spaces = imports.where("module_type in ('namespace', 'side_effect')").join(named.select("src_path").distinct(), "src_path").select("path", F.lit("*").alias("name"), F.col("module_type").alias("import_type"))
    plain = changed.select("path").distinct().join(facts["symbols"].select("path").distinct(), "path", "left_anti").select(F.col("path").alias("src_path"))
    others = imports.join(plain, "src_path").select("path", F.lit("").alias("name"), F.lit("file").alias("import_type"))
    return direct.union(spaces).union(others).distinct().join(changed.select("path").distinct(), "path", "left_anti")


def file_impact(facts, changed: DataFrame, max_depth: int = 6) -> DataFrame:
    """(path, level, symbols): files that import changed exports (level 1, with how many of them), and what imports those; changed files are left out."""
    direct = durable(direct_importers(facts, changed), "direct")
    seeds = direct.select(F.col("path").alias("node")).distinct()
    levels = graph.reach_levels(graph.reverse_edges(file_edges(facts)), seeds, max_depth - 1, first_level=1)
    counts = direct.groupBy("path").agg(F.count_distinct("name").alias("symbols"))
    return levels.select(F.col("node").alias("path"), "level").join(changed.select("path").distinct(), "path", "left_anti").join(counts, "path", "left").select("path", "level", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def file_impact_paths(facts, changed: DataFrame, max_depth: int = 6) -> DataFrame:
    """(path, level, way): one shortest way from a directly affected file, the alphabetically first predecessor at each step."""
    seeds = direct_importers(facts, changed).select(F.col("path").alias("node")).distinct()
    ways = graph.shortest_ways(graph.reverse_edges(file_edges(facts)), seeds, max_depth - 1)
    return ways.select(F.col("node").alias("path"), (F.col("level") + 1).alias("level"), F.array_join("steps", " → ").alias("way"))


def find_callers(facts, path: str) -> DataFrame:
    """(path, level) of all files that reach the given one through imports."""
    seed = facts["files"].where(F.col("path") == path).select(F.col("path").alias("node"))
    return graph.reach_levels(graph.reverse_edges(file_edges(facts)), seed, None).where("level > 0").select(F.col("node").alias("path"), "level")


def component_impact(facts, components: DataFrame, changed: DataFrame, max_depth: int = 10) -> DataFrame:
    """(component, kind, level): changed components (direct, level 0), and as indirect all that depend on them at the largest level they are met with; a changed component that another one leads to is both."""
    seeds = component_of(changed, components).select(F.col("component").alias("node")).distinct()
    edges = graph.reverse_edges(component_edges(facts, components))
    after = graph.levels_max(edges, seeds, max_depth)
    return seeds.select(F.col("node").alias("component"), F.lit("direct").alias("kind"), F.lit(0).alias("level")).union(after.select("node", F.lit("indirect"), "level"))


def level_histogram(impacts: DataFrame) -> DataFrame:
    """(level, n) over (…, level)."""
    return impacts.groupBy("level").agg(F.count("*").alias("n"))


def by_level_and_name(impacts: DataFrame, name: str) -> DataFrame:
    """Deepest levels first, names in order."""
    return impacts.orderBy(F.desc("level"), name)


def by_risk(impacts: DataFrame, risk: str, name: str) -> DataFrame:
    """critical, high, medium, low; then levels and names."""
    order = F.when(F.col(risk) == "critical", 0).when(F.col(risk) == "high", 1).when(F.col(risk) == "medium", 2).when(F.col(risk) == "low", 3).otherwise(4)
    return impacts.orderBy(order, "level", name)


def classify_changed(changed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, category, name): changed files by manifest (name, type, path): component, functions or other; a component wins, then the deepest folder."""
    paths = changed.select("path").distinct()
    # A file is in a folder that is the path itself or one of its leading parts.
    parts = F.split("path", "/")
    up = paths.withColumn("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    hit = up.join(manifest.select("name", F.col("type"), F.col("path").alias("folder")), "folder")
    best = hit.groupBy("path").agg(F.min_by(F.struct("type", "name"), F.struct(F.col("type") != "component", -F.length("folder"), F.col("name"))).alias("b"))
    return paths.join(best, "path", "left").select("path", F.coalesce("b.type", F.lit("other")).alias("category"), F.coalesce("b.name", F.lit("")).alias("name"))


def mr_impact(facts, components: DataFrame, changed: DataFrame) -> DataFrame:
    """(source, component, relation, level, way): for each changed component all that depend on it at the least level: `depends` at 1, `indirect` with one shortest way beyond."""
    seeds = component_of(changed, components).select(F.col("component").alias("node")).distinct()
    edges = graph.reverse_edges(component_edges(facts, components))
    # One search for each source, all at once: nodes are pairs of source and component.
    ways = graph.shortest_ways_by_source(edges, seeds).where("level > 0")
    relation = F.when(F.col("level") == 1, "depends").otherwise("indirect")
    return ways.select("source", F.col("node").alias("component"), relation.alias("relation"), "level", F.when(F.col("level") > 1, F.array_join("steps", " → ")).alias("way"))
