"""Scoped name binding: which declaration each use of a name means, across shadowing, imports and re-exports; all as joins on scopes, bindings and uses (sources/names.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.containment import enclosing
from factloom.tables import grown


def bound_names(name_rows: DataFrame) -> DataFrame:
    """(path, scope, name, pos, how, top): every binding with the scope that it holds in: `var` in the nearest function, all else in the nearest scope; of one
    name in one scope the first binding stands for all. top tells the file's own scope."""
    scopes = name_rows.where("kind = 'scope'").select("path", "id", "pos", "end", "name")
    given = name_rows.where("kind = 'binding'").select("path", F.col("id").alias("item"), "pos", "end", "name", F.col("more").alias("how"))
    near = enclosing(scopes, given.where("how <> 'var'"), nearest=True)
    wide = enclosing(scopes.where("name in ('function', 'file')"), given.where("how = 'var'"), nearest=True)
    held = given.join(grown(near.union(wide).select("path", "item", F.col("id").alias("scope"))), ["path", "item"])
    first = held.groupBy("path", "scope", "name").agg(F.min_by(F.struct("pos", "how"), "pos").alias("b"))
    kinds = scopes.select("path", F.col("id").alias("scope"), (F.col("name") == "file").alias("top"))
    return first.join(grown(kinds), ["path", "scope"]).select("path", "scope", "name", "b.pos", "b.how", "top")


def resolved_uses(name_rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """(path, name, pos, line, column, def_pos, how, top): each use with the binding of the innermost scope around that binds its name; uses of global names have none."""
    uses = name_rows.where("kind = 'use'").select("path", F.col("id").alias("item"), "name", "pos", "end", "line", "column")
    scopes = name_rows.where("kind = 'scope'").select("path", "id", "pos", "end")
    # Only scopes that bind anything can decide.
    scopes = scopes.join(grown(bindings.select("path", F.col("scope").alias("id")).distinct()), ["path", "id"], "left_semi")
    around = enclosing(scopes, uses.select("path", "item", "pos", "end")).select("path", "item", F.col("id").alias("scope"), "distance")
    hits = uses.select("path", "item", "name").join(grown(around), ["path", "item"]).join(grown(bindings.withColumnRenamed("pos", "def_pos")), ["path", "scope", "name"])
    best = hits.groupBy("path", "item").agg(F.min_by(F.struct("def_pos", "how", "top"), "distance").alias("b"))
    return uses.join(best, ["path", "item"], "left").select("path", "name", "pos", "line", "column", "b.*")


def meanings(facts) -> DataFrame:
    """(path, name, pos, line, column, def_path, def_name, def_pos): every bound use with the declaration that it means, imports followed through any number of re-exports to the file that declares."""
    bindings, uses = facts["bindings"], facts["uses"].where("def_pos is not null")
    # An imported name: the origin of what it takes, and there the local name behind the exported one.
    taken = facts["imports"].where("src_type = 'file' and module_type in ('named', 'default')").select("path", F.col("identifier").alias("name"), F.col("src_path"), F.col("import_module"))
    origins = facts["origins"].select(F.col("path").alias("src_path"), F.col("name").alias("import_module"), "origin_path", F.col("origin_name"))
    local = facts["exports"].select(F.col("path").alias("origin_path"), F.col("name").alias("origin_name"), F.coalesce(F.nullif("local_name", F.lit("")), "name").alias("def_name"))
    tops = bindings.where("top").select(F.col("path").alias("origin_path"), F.col("name").alias("def_name"), F.col("pos").alias("far_pos"))
    far = taken.join(grown(origins), ["src_path", "import_module"]).join(grown(local), ["origin_path", "origin_name"]).join(grown(tops), ["origin_path", "def_name"])
    far = far.groupBy("path", "name").agg(F.min(F.struct("origin_path", "def_name", "far_pos")).alias("f")).withColumn("how", F.lit("import")).withColumn("top", F.lit(True))
    out = uses.join(far, ["path", "name", "how", "top"], "left")
    return out.select(
        "path", "name", "pos", "line", "column", F.coalesce("f.origin_path", "path").alias("def_path"), F.coalesce("f.def_name", "name").alias("def_name"), F.coalesce("f.far_pos", "def_pos").alias("def_pos"),
    )


def at_points(facts, points: DataFrame) -> DataFrame:
    """points (path, line, column) with name, def_path, def_name and def_pos of the name that stands there; a point anywhere inside a name counts."""
    known = meanings(facts).withColumn("length", F.length("name"))
    hit = points.select("path", "line", F.col("column").alias("at")).join(known, ["path", "line"]).where("at >= column and at < column + length")
    return hit.select("path", "line", F.col("at").alias("column"), "name", "def_path", "def_name", "def_pos")


def goto_definition(facts, points: DataFrame) -> DataFrame:
    """points (path, line, column) with name, def_path, def_line and def_column."""
    where = facts["names"].where("kind = 'binding'").select(F.col("path").alias("def_path"), F.col("pos").alias("def_pos"), F.col("line").alias("def_line"), F.col("column").alias("def_column"))
    return at_points(facts, points).join(grown(where), ["def_path", "def_pos"]).select("path", "line", "column", "name", "def_path", "def_line", "def_column")


def find_references(facts, points: DataFrame) -> DataFrame:
    """points (path, line, column) with ref_path, ref_line, ref_column, ref_name: every place that means the same declaration, this one and imports of it included."""
    wanted = at_points(facts, points).drop("name", "def_name")
    every = meanings(facts).select(F.col("path").alias("ref_path"), F.col("line").alias("ref_line"), F.col("column").alias("ref_column"), F.col("name").alias("ref_name"), "def_path", "def_pos")
    return wanted.join(every, ["def_path", "def_pos"]).select("path", "line", "column", "ref_path", "ref_line", "ref_column", "ref_name").distinct()


def reference_counts(facts) -> DataFrame:
    """(path, name, line, references, files): how often each declaration at the top of a file is meant, and in how many files."""
    known = meanings(facts).groupBy(F.col("def_path").alias("path"), F.col("def_pos").alias("pos")).agg(F.count("*").alias("references"), F.count_distinct("path").alias("files"))
    own = facts["bindings"].where("top and how <> 'import'").select("path", "name", "pos")
    lines = facts["names"].where("kind = 'binding'").select("path", "pos", "line").distinct()
    return grown(own).join(known, ["path", "pos"]).join(grown(lines), ["path", "pos"]).select("path", "name", "line", "references", "files")
