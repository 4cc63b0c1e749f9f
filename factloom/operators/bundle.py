"""Type bundles: from entry types all types that they need, under names that do not clash, in one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import base_name, short_hash
from factloom.operators import graph
from factloom.operators.analyzers import Facts
from factloom.sources.writers import write_named_files
from factloom.tables import durable

_KINDS = ["interface", "type", "class", "enum"]


def entries_of(texts: DataFrame) -> DataFrame:
    """texts (entry) `file:type[:alias]` to (path, type, alias)."""
    p = F.split("entry", ":")
    return texts.select(p[0].alias("path"), p[1].alias("type"), F.when(F.size(p) > 2, p[2]).otherwise(p[1]).alias("alias"))


def _bindings(facts) -> DataFrame:
    """(path, reference, to_path, to_type): what a type name stands for in a file: its own declaration, an import, a namespace's member, or a global declaration."""
    own = facts["nodes"].where(F.col("kind").isin(_KINDS)).select("path", "name").distinct()
    local = own.select("path", F.col("name").alias("reference"), F.col("path").alias("to_path"), F.col("name").alias("to_type"), F.lit(0).alias("rank"))
    shown = facts["origins"].join(facts["exports"].select(F.col("path").alias("origin_path"), F.col("name").alias("origin_name"), "local_name"), ["origin_path", "origin_name"])
    shown = shown.select(F.col("path").alias("src_path"), F.col("name").alias("import_module"), F.col("origin_path").alias("to_path"), F.coalesce(F.nullif("local_name", F.lit("")), "origin_name").alias("to_type"))
    taken = facts["imports"].where("src_type = 'file'")
    named = taken.where("module_type in ('named', 'default')").join(shown, ["src_path", "import_module"]).select("path", F.col("identifier").alias("reference"), "to_path", "to_type", F.lit(1).alias("rank"))
    space = taken.where("module_type = 'namespace'").drop("import_module").join(shown, "src_path").select("path", F.concat_ws(".", "identifier", "import_module").alias("reference"), "to_path", "to_type", F.lit(1).alias("rank"))
    # Declarations are global only where their file neither imports nor exports anything.
    modules = facts["imports"].select("path").union(facts["exports"].select("path")).union(facts["re_exports"].select("path")).distinct()
    world = own.where(F.col("path").endswith(".d.ts")).join(modules, "path", "left_anti").groupBy("name").agg(F.min("path").alias("to_path")).select(F.col("name").alias("reference"), "to_path", F.col("name").alias("to_type"))
    refs = facts["type_refs"].select("path", "reference").distinct()
    global_ = refs.join(world, "reference").select("path", "reference", "to_path", "to_type", F.lit(2).alias("rank"))
    every = local.union(named).union(space).union(global_)
    return every.groupBy("path", "reference").agg(F.min_by(F.struct("to_path", "to_type"), "rank").alias("t")).select("path", "reference", "t.*")


def closure(facts, entries: DataFrame) -> DataFrame:
    """(path, type) of all types that the entries (path, type) need, through references, imports, re-exports and global declarations."""
    needs = facts["type_refs"].join(_bindings(facts), ["path", "reference"]).select("path", "type", "to_path", "to_type").distinct()
    needs = durable(needs, "type-needs")
    # An entry may name a re-export.
    via = entries.select("path", F.col("type").alias("name")).join(facts["origins"], ["path", "name"], "left")
    frontier = durable(via.select(F.coalesce("origin_path", "path").alias("path"), F.coalesce("origin_name", "name").alias("type")).distinct(), "types")
    seen, rounds = frontier, 0
    while True:
        found = frontier.join(needs, ["path", "type"]).select(F.col("to_path").alias("path"), F.col("to_type").alias("type")).distinct()
        frontier = durable(found.join(seen, ["path", "type"], "left_anti"), "types")
        if frontier.isEmpty():
            return seen
        seen, rounds = seen.union(frontier), rounds + 1
        if rounds % 6 == 0:
            seen = durable(seen, "types")


def closures(facts, entries: DataFrame) -> DataFrame:
    """(entry, path, type): for each of the entries (path, type) on its own all types that it needs; entry is `path:type`. One search for all: what two entries share is
    found for both, but the needs of a type are looked up in one table."""
    needs = durable(facts["type_refs"].join(_bindings(facts), ["path", "reference"]).select("path", "type", "to_path", "to_type").distinct(), "type-needs")
    named = entries.select("path", "type").distinct().withColumn("entry", F.concat_ws(":", "path", "type")).withColumnRenamed("type", "name")
    shown = facts["origins"].join(facts["exports"].select(F.col("path").alias("origin_path"), F.col("name").alias("origin_name"), "local_name"), ["origin_path", "origin_name"], "left")
    shown = shown.select("path", "name", "origin_path", F.coalesce(F.nullif("local_name", F.lit("")), "origin_name").alias("to"))
    start = named.join(shown, ["path", "name"], "left").select("entry", F.coalesce("origin_path", "path").alias("path"), F.coalesce("to", "name").alias("type"))
    frontier = durable(start.distinct(), "labelled-types")
    seen, rounds = frontier, 0
    while True:
        found = frontier.join(needs, ["path", "type"]).select("entry", F.col("to_path").alias("path"), F.col("to_type").alias("type")).distinct()
        frontier = durable(found.join(seen, ["entry", "path", "type"], "left_anti"), "labelled-types")
        if frontier.isEmpty():
            break
        seen, rounds = seen.union(frontier), rounds + 1
        if rounds % 6 == 0:
            seen = durable(seen, "labelled-types")
    # A name that is declared nowhere needs nothing.
    declared = facts["nodes"].where(F.col("kind").isin(_KINDS)).select("path", F.col("name").alias("type")).distinct()
    return seen.join(declared, ["path", "type"], "left_semi").select("entry", "path", "type")


def final_names(types: DataFrame, *keys: str) -> DataFrame:
    """types (path, type) with final_name, apart for each of the keys: of types of one name the first, by path, keeps it; the others get their file's name behind, and a short hash where that clashes too."""
    nth = F.row_number().over(Window.partitionBy(*keys, "type").orderBy("path"))
    stem = F.regexp_replace(F.regexp_replace(base_name(F.col("path")), r"(\.d)?\.[^.]+$", ""), r"[^\w$]", "_")
    named = types.withColumn("nth", nth).withColumn("final_name", F.when(F.col("nth") == 1, F.col("type")).otherwise(F.concat_ws("_", "type", stem)))
    again = F.row_number().over(Window.partitionBy(*keys, "final_name").orderBy("nth", "path"))
    return named.withColumn("again", again).withColumn("final_name", F.when(F.col("again") > 1, F.concat_ws("_", "final_name", short_hash(F.col("path")))).otherwise(F.col("final_name"))).drop("nth", "again")


#: What a declaration's text consists of: strings and comments, member names with their colon, names with their dots, anything else.
_WORDS = r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*\??:|[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*|[^A-Za-z_$"'`/]+|."""


def renamed_text(text: Column, rules: Column) -> Column:
    """text with all names of the map rules replaced at once, so that no rule meets what another one wrote; strings, comments and member names stay. Of a dotted name that is in no rule the first part counts."""
    head = lambda w: F.substring_index(w, ".", 1)
    one = lambda w: F.coalesce(rules[w], F.when(w.contains("."), F.concat(rules[head(w)], F.substring(w, F.length(head(w)) + 1, F.length(w)))), w)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), one), "")


def _texts(facts, names: DataFrame, keys: list[str]) -> DataFrame:
    """names (keys, path, type, final_name) with the text of each declaration, its references under their final names."""
    texts = facts["nodes"].where(F.col("kind").isin(_KINDS)).groupBy("path", F.col("name").alias("type")).agg(F.min_by("text", "id").alias("text"))
    bound = facts["type_refs"].select("path", "type", "reference").join(_bindings(facts), ["path", "reference"])
    bound = bound.join(names.select(*keys, "path", "type"), ["path", "type"])
    target = names.select(*keys, F.col("path").alias("to_path"), F.col("type").alias("to_type"), "final_name")
    bound = bound.join(target, [*keys, "to_path", "to_type"]).where("reference <> final_name").select(*keys, "path", "type", "reference", "final_name")
    own = names.where("type <> final_name").select(*keys, "path", "type", F.col("type").alias("reference"), "final_name")
    rules = bound.union(own).distinct().groupBy(*keys, "path", "type").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("reference", "final_name")))).alias("rules"))
    rewritten = renamed_text(F.col("text"), F.coalesce("rules", F.create_map().cast("map<string,string>")))
    return names.join(texts, ["path", "type"]).join(rules, [*keys, "path", "type"], "left").select(*keys, "final_name", "path", "type", rewritten.alias("text"))


def bundle(facts, entries: DataFrame) -> DataFrame:
    """(final_name, path, type, text): the declarations of the closure of all entries together, references rewritten to final names, in order of final names."""
    names = durable(final_names(closure(facts, entries)), "final-names")
    return _texts(facts, names, []).orderBy("final_name")


def bundles(facts, entries: DataFrame) -> DataFrame:
    """(entry, final_name, path, type, text): a bundle for each of the entries (path, type, alias) on its own; the entry's type has its alias, if that is free, as final name."""
    types = closures(facts, entries)
    names = final_names(types, "entry")
    shown = facts["origins"].select(F.col("path").alias("p"), F.col("name").alias("n"), "origin_path", "origin_name")
    wanted = entries.where("alias is not null and alias <> type").groupBy("path", "type").agg(F.min("alias").alias("alias")).withColumn("entry", F.concat_ws(":", "path", "type"))
    wanted = wanted.join(shown, (F.col("path") == F.col("p")) & (F.col("type") == F.col("n")), "left").select("entry", F.coalesce("origin_path", "path").alias("path"), F.coalesce("origin_name", "type").alias("type"), "alias")
    wanted = wanted.join(names.select("entry", F.col("final_name").alias("alias")), ["entry", "alias"], "left_anti")
    names = names.join(wanted, ["entry", "path", "type"], "left").withColumn("final_name", F.coalesce("alias", "final_name")).drop("alias")
    return _texts(facts, durable(names, "final-names"), ["entry"])


def write_bundles(rows: DataFrame, folder: str) -> None:
    """One file for each entry below folder, `<file>.<type>.d.ts` beside the folders of the sources, its declarations exported in order of their names. Files are written by tasks."""
    text = F.when(F.col("text").startswith("export"), F.col("text")).otherwise(F.concat(F.lit("export "), "text"))
    whole = rows.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("final_name", text.alias("text")))).alias("all"))
    name = F.concat(F.regexp_replace(F.regexp_extract("entry", r"^(.*):[^:]*$", 1), r"(\.d)?\.[^./]+$", ""), F.lit("."), F.regexp_extract("entry", r":([^:]*)$", 1), F.lit(".d.ts"))
    write_named_files(whole.select(name.alias("name"), F.concat(F.array_join(F.transform("all", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text")), folder)


def write_bundle(rows: DataFrame, folder: str) -> None:
    """One text file with all declarations, exported."""
    text = F.when(F.col("text").startswith("export"), F.col("text")).otherwise(F.concat(F.lit("export "), "text"))
    rows.orderBy("final_name").select(text.alias("value")).coalesce(1).write.mode("overwrite").text(folder)


def package_of(path: Column) -> Column:
    """The package that a file below node_modules belongs to; type packages stand for what they describe."""
    name = F.regexp_extract(path, r"^node_modules/((?:@[^/]+/)?[^/]+)/", 1)
    described = F.regexp_replace(name, "^@types/", "")
    return F.when(name.startswith("@types/"), F.when(described.contains("__"), F.concat(F.lit("@"), F.replace(described, F.lit("__"), F.lit("/")))).otherwise(described)).otherwise(name)


def with_packages(files: DataFrame, aliases: DataFrame, installed: DataFrame) -> Facts:
    """Facts of a project whose imports from packages lead into their declaration files. installed: (path, content, ...) below node_modules. Only declaration files of
    packages that the project imports, or that those depend on, are read."""
    base = Facts(files, aliases)
    used = base["imports"].where("npm_pkg is not null").select(F.col("npm_pkg").alias("node")).distinct()
    manifests = installed.where(F.col("path").rlike(r"^node_modules/(@[^/]+/)?[^/]+/package\.json$")).select("path", "content")
    lists = F.from_json("content", "dependencies map<string,string>, peerDependencies map<string,string>")
    names = F.flatten(F.array(*[F.coalesce(F.map_keys(lists[k]), F.array().cast("array<string>")) for k in ("dependencies", "peerDependencies")]))
    edges = manifests.select(package_of(F.col("path")).alias("src"), F.explode(names).alias("dst")).where("src <> dst").distinct()
    reached = durable(graph.reach_levels(edges, used, None).select(F.col("node").alias("name")).distinct(), "packages-reached")
    declarations = installed.where(F.col("path").endswith(".d.ts")).withColumn("name", package_of(F.col("path"))).join(reached, "name", "left_semi").drop("name")
    declarations = declarations.select(*[c if c in declarations.columns else F.lit(None).alias(c) for c in files.columns])
    entry = type_entry(manifests, declarations.select("path"), reached)
    folders = declarations.select(package_of(F.col("path")).alias("alias"), F.regexp_extract("path", r"^(node_modules/(?:@[^/]+/)?[^/]+)/", 1).alias("target")).distinct()
    given = entry.select(F.col("name").alias("alias"), F.col("path").alias("target")).union(folders)
    if "config_dir" in aliases.columns:
        given = given.select(F.lit(None).cast("string").alias("config_dir"), "alias", "target")
    return Facts(durable(files.unionByName(declarations), "files-and-declarations"), durable(aliases.unionByName(given), "aliases"))


def type_entry(manifests: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(name, path): the declaration file of each package (name): `types` or `typings` of its manifest, index.d.ts, or the same of @types."""
    own = manifests.where(F.col("path").rlike(r"node_modules/.*package\.json$")).select(F.regexp_replace("path", r"/package\.json$", "").alias("folder"), F.coalesce(F.get_json_object("content", "$.types"), F.get_json_object("content", "$.typings")).alias("types"))
    wanted = packages.select("name").distinct().withColumn("folder", F.explode(F.array(F.concat(F.lit("node_modules/"), "name"), F.concat(F.lit("node_modules/@types/"), F.regexp_replace(F.regexp_replace("name", "^@", ""), "/", "__")))))
    tried = wanted.withColumn("rank", F.col("folder").contains("@types/").cast("int")).join(own, "folder", "left")
    tried = tried.select("name", F.posexplode(F.array(F.concat_ws("/", "folder", F.regexp_replace("types", r"^\./", "")), F.concat("folder", F.lit("/index.d.ts")))).alias("nth", "path"), "rank")
    return tried.join(files.select("path"), "path").groupBy("name").agg(F.min_by("path", F.struct("rank", "nth")).alias("path"))
