"""Going about in the nodes of files: positions, ancestors, kinds, symbols, references and definitions, all as joins on the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.operators.containment import enclosing

#: Groups of kinds.
CATEGORIES = {
    "declaration": ["function", "class", "interface", "type", "enum", "variable", "parameter", "member"],
    "type": ["interface", "type", "enum", "reference", "member"],
    "function": ["function"],
    "expression": ["call", "as", "jsx"],
    "statement": ["return", "variable"],
    "keyword": ["any"],
}


def with_category(node_rows: DataFrame) -> DataFrame:
    """nodes with category, once for each group that their kind is in."""
    spark = node_rows.sparkSession
    kinds = spark.createDataFrame([(k, c) for c, ks in CATEGORIES.items() for k in ks], "kind string, category string")
    return node_rows.join(F.broadcast(kinds), "kind")


def of_kind(node_rows: DataFrame, *kinds: str) -> DataFrame:
    return node_rows.where(F.col("kind").isin(*kinds))


def parents(node_rows: DataFrame) -> DataFrame:
    """(path, id, parent, parent_kind, parent_name) of nodes inside a declaration."""
    up = node_rows.select("path", F.col("id").alias("parent"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name"))
    return node_rows.select("path", "id", "parent").join(up, ["path", "parent"]).select("path", "id", "parent", "parent_kind", "parent_name")


def ancestors(node_rows: DataFrame) -> DataFrame:
    """(path, id, ancestor, distance): all declarations around each node, the nearest at distance 1."""
    outer = of_kind(node_rows, *CATEGORIES["declaration"][:6])
    pairs = enclosing(outer.select("path", "id", "pos", "end"), node_rows.select("path", F.col("id").alias("item"), "pos", "end"), one_table=True)
    return pairs.select("path", F.col("item").cast("int").alias("id"), F.col("id").cast("int").alias("ancestor"), "distance")


def first_ancestor(node_rows: DataFrame, *kinds: str) -> DataFrame:
    """(path, id, ancestor): the nearest ancestor of one of the kinds."""
    up = ancestors(node_rows).join(of_kind(node_rows, *kinds).select("path", F.col("id").alias("ancestor")), ["path", "ancestor"])
    return up.groupBy("path", "id").agg(F.min_by("ancestor", "distance").alias("ancestor"))


def descendants(node_rows: DataFrame) -> DataFrame:
    """(path, id, descendant, distance)."""
    return ancestors(node_rows).select("path", F.col("ancestor").alias("id"), F.col("id").alias("descendant"), "distance")


def children(node_rows: DataFrame) -> DataFrame:
    """(path, id, children): ids of the nodes directly inside, in order."""
    return node_rows.where("parent >= 0").groupBy("path", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))


def _nearest(points: DataFrame, at: str, outer: DataFrame, kept: list[str]) -> DataFrame:
    """points with the columns `kept` of the innermost row of outer (path, id, pos, end, nth) around column `at`."""
    wanted = points.select("path", at).distinct()
    # The place itself tells a point of a file apart.
    hit = enclosing(outer.select("path", "id", "pos", "end", "nth"), wanted.select("path", F.col(at).cast("long").alias("item"), F.col(at).alias("pos"), (F.col(at) + 1).alias("end")), nearest=True)
    hit = hit.select("path", F.col("item").alias("_at"), F.col("id").alias("_id"))
    found = wanted.withColumn("_at", F.col(at).cast("long")).join(hit, ["path", "_at"]).join(outer.withColumn("_id", F.col("id").cast("long")).select("path", "_id", *kept), ["path", "_id"])
    return found.select("path", at, *kept)


def node_at(node_rows: DataFrame, points: DataFrame) -> DataFrame:
    """points (path, offset) with the node of the smallest extent around: id, kind, name; of equal extents the first."""
    return _nearest(points, "offset", node_rows.withColumn("nth", -F.col("id")), ["id", "kind", "name"])


def symbol_at(node_rows: DataFrame, points: DataFrame) -> DataFrame:
    """points (path, line) with the smallest declaration around: name, kind, start_line, end_line."""
    # Extents in lines; of those that share their lines the one with the fewest letters is the innermost.
    outer = of_kind(node_rows, "function", "class", "interface", "type", "enum", "variable").withColumn("nth", F.col("pos") - F.col("end"))
    outer = outer.withColumn("pos", F.col("start_line")).withColumn("end", F.col("end_line") + 1)
    return _nearest(points, "line", outer, ["name", "kind", "start_line", "end_line"])


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """symbols with an id of (path, name); equal ids are one symbol."""
    return symbols.withColumn("symbol_id", F.sha2(F.concat_ws("\0", "path", "name"), 256))


def definitions(facts) -> DataFrame:
    """(path, name, def_path, def_name, line): where each imported or own name is declared, re-exports followed."""
    own = facts["symbols"].select("path", "name", F.col("path").alias("def_path"), F.col("name").alias("def_name"))
    taken = facts["imports"].where("src_type = 'file' and module_type in ('named', 'default')").select(F.col("path").alias("p"), F.col("identifier").alias("i"), F.col("src_path").alias("path"), F.col("import_module").alias("name"))
    via = taken.join(facts["origins"], ["path", "name"]).select(F.col("p").alias("path"), F.col("i").alias("name"), F.col("origin_path").alias("def_path"), F.col("origin_name").alias("o"))
    local = facts["exports"].select(F.col("path").alias("def_path"), F.col("name").alias("o"), F.coalesce(F.nullif("local_name", F.lit("")), "name").alias("def_name"))
    both = own.union(via.join(local, ["def_path", "o"]).select("path", "name", "def_path", "def_name"))
    where = facts["symbols"].groupBy(F.col("path").alias("def_path"), F.col("name").alias("def_name")).agg(F.min("start_line").alias("line"))
    return both.distinct().join(where, ["def_path", "def_name"], "left").select("path", "name", "def_path", "def_name", "line")


def find_references(facts, path: str, name: str) -> DataFrame:
    """(path, name, kind): files where a declaration of path is declared, imported, exported again or taken as a whole, under the name it has there."""
    hit = (F.col("def_path") == path) & (F.col("def_name") == name)
    bound = definitions(facts).where(hit).select("path", "name", F.when(F.col("path") == path, "declaration").otherwise("import").alias("kind"))
    shown = facts["exports"].where((F.col("path") == path) & ((F.col("local_name") == name) | (F.col("name") == name))).select(F.col("path").alias("origin_path"), F.col("name").alias("origin_name"))
    again = facts["origins"].join(shown, ["origin_path", "origin_name"]).where("path <> origin_path").select("path", "name")
    spaces = facts["imports"].where("src_type = 'file' and module_type = 'namespace'").select(F.col("path").alias("p"), F.col("identifier").alias("i"), F.col("src_path").alias("path"))
    whole = spaces.join(again.union(shown.toDF("path", "name")), "path").where("name <> 'default'").select(F.col("p").alias("path"), F.concat_ws(".", "i", "name").alias("name"), F.lit("namespace").alias("kind"))
    return bound.union(again.withColumn("kind", F.lit("re_export"))).union(whole).distinct()


def goto_definition(facts, points: DataFrame) -> DataFrame:
    """points (path, name) with def_path, def_name, line."""
    return points.join(definitions(facts), ["path", "name"])


def quick_info(facts, points: DataFrame) -> DataFrame:
    """points (path, name) with kind and the declared text, up to its body."""
    own = facts["nodes"].where(F.col("kind").isin("function", "class", "interface", "type", "enum", "variable")).select("path", "name", "kind", "id", F.trim(F.regexp_extract("text", r"(?s)^([^{;]*)", 1)).alias("declared"))
    best = own.groupBy("path", "name").agg(F.min_by(F.struct("kind", "declared"), "id").alias("n"))
    return points.join(best, ["path", "name"]).select("path", "name", "n.*")


def without_files(files: DataFrame, removed: DataFrame) -> DataFrame:
    return files.join(removed.select("path").distinct(), "path", "left_anti")


def with_files(files: DataFrame, added: DataFrame) -> DataFrame:
    """files with the added ones, which replace files of the same path."""
    return without_files(files, added).unionByName(added, allowMissingColumns=True)


def enclosing_chain(node_rows: DataFrame) -> DataFrame:
    """(path, id, level): how deep each node's parents go, found along parent edges."""
    edges = node_rows.where("parent >= 0").select(F.concat_ws("#", "path", "parent").alias("src"), F.concat_ws("#", "path", "id").alias("dst"))
    tops = node_rows.where("parent = -1").select(F.concat_ws("#", "path", "id").alias("node"))
    return graph.reach_levels(edges, tops, None)
