"""Compiler configurations: found among the files, merged along `extends`, and turned into aliases for resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import folder_of, glob_regex
from factloom.operators import relational
from factloom.sources.code_facts import plain_path
from factloom.tables import durable

#: Names of configurations.
NAMES = ["tsconfig.json", "tsconfig.base.json", "jsconfig.json"]
_OPTIONS = "compilerOptions struct<baseUrl string, paths map<string, array<string>>, target string, module string, jsx string, strict boolean>, extends string, include array<string>, exclude array<string>, files array<string>"


def without_comments(text: Column) -> Column:
    """JSON with comments and trailing commas, as plain JSON. Strings that hold comment marks stay."""
    text = F.regexp_replace(text, r'(?s)("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', "$1")
    return F.regexp_replace(text, r"(?s),(\s*[}\]])", "$1")


def format_alias(alias: Column) -> Column:
    """`@/*` to `@`."""
    return F.regexp_replace(alias, r"/?\*$", "")


def configs(files: DataFrame) -> DataFrame:
    """(path, config_dir, parent, base_url, paths, include, exclude, files) of every configuration in files (path, content); parent is the path it extends."""
    own = files.where(F.col("path").rlike(r"(^|/)(" + "|".join(n.replace(".", r"\.") for n in NAMES) + r"|tsconfig\.[\w.-]+\.json)$"))
    j = own.select("path", folder_of(F.col("path")).alias("config_dir"), F.from_json(without_comments(F.col("content")), _OPTIONS).alias("j"))
    up = plain_path(F.concat_ws("/", F.nullif("config_dir", F.lit("")), "j.extends"))
    parent = F.when(F.col("j.extends").startswith("."), F.when(up.endswith(".json"), up).otherwise(F.concat(up, F.lit(".json"))))
    base = F.when(F.col("j.compilerOptions.baseUrl").isNotNull(), plain_path(F.concat_ws("/", F.nullif("config_dir", F.lit("")), "j.compilerOptions.baseUrl")))
    return j.select("path", "config_dir", parent.alias("parent"), base.alias("base_url"), F.col("j.compilerOptions.paths").alias("paths"), "j.include", "j.exclude", "j.files", F.col("j.compilerOptions").alias("options"))


def merged(config_rows: DataFrame) -> DataFrame:
    """(path, config_dir, base_url, paths, ...) with what parents give, any number of them; the child wins. A circle of parents ends where it would close."""
    state = durable(config_rows.withColumn("seen", F.array("path")), "configs")
    taken = ["base_url", "paths", "include", "exclude", "files"]
    while True:
        up = config_rows.select(F.col("path").alias("parent"), F.col("parent").alias("_next"), *[F.col(c).alias(f"_{c}") for c in taken])
        joined = state.join(up, "parent", "left")
        both = F.when(F.col("paths").isNull(), F.col("_paths")).when(F.col("_paths").isNull(), F.col("paths")).otherwise(F.map_concat(F.map_filter("_paths", lambda k, _: ~F.map_contains_key("paths", k)), "paths"))
        kept = [both.alias(c) if c == "paths" else F.coalesce(c, f"_{c}").alias(c) for c in taken]
        following = F.when(F.array_contains("seen", F.col("_next")), None).otherwise(F.col("_next"))
        open_ = state.where("parent is not null").isEmpty()
        if open_:
            return state.drop("seen", "parent")
        state = durable(joined.select("path", "config_dir", following.alias("parent"), *kept, "options", F.concat("seen", F.array(F.coalesce("_next", F.lit("")))).alias("seen")), "configs")


def aliases(config_rows: DataFrame) -> DataFrame:
    """(config_dir, alias, target) for code_facts.resolve(): only the first target of a path counts; the base folder has the empty alias. Of several configurations in one folder the leading one counts."""
    config_rows = leading(config_rows)
    base = F.coalesce("base_url", "config_dir")
    listed = config_rows.where("paths is not null").select("config_dir", base.alias("base"), F.explode("paths").alias("alias", "targets"))
    target = plain_path(F.concat_ws("/", F.nullif("base", F.lit("")), format_alias(F.element_at("targets", 1))))
    folder = config_rows.where("base_url is not null").select("config_dir", F.lit("").alias("alias"), F.col("base_url").alias("target"))
    none = config_rows.where("base_url is null and paths is null").select("config_dir", F.lit(" ").alias("alias"), F.lit("").alias("target"))
    return listed.select("config_dir", format_alias(F.col("alias")).alias("alias"), target.alias("target")).union(folder).union(none)


def nearest(items: DataFrame, folders: DataFrame) -> DataFrame:
    """items (path, ...) with config_dir, the deepest of folders (config_dir) above the path; items without one are left out."""
    up = relational.longest_prefix(items.select("path").distinct().withColumn("_p", F.concat(F.lit("/"), "path")), "_p", folders.select(F.when(F.col("config_dir") == "", "").otherwise(F.concat(F.lit("/"), "config_dir")).alias("_f")), "_f")
    return items.join(up.select("path", F.substring("_f", 2, 1 << 30).alias("config_dir")), "path")


def leading(config_rows: DataFrame) -> DataFrame:
    """One configuration for each folder: tsconfig.json, else jsconfig.json, else the first by name."""
    name = F.regexp_replace("path", "^.*/", "")
    order = F.struct(F.when(name == "tsconfig.json", 0).when(name == "jsconfig.json", 1).otherwise(2), F.col("path"))
    return config_rows.join(config_rows.groupBy("config_dir").agg(F.min_by("path", order).alias("path")), ["config_dir", "path"], "left_semi")


def glob_column(glob: Column) -> Column:
    """A regular expression for each glob of a column; a folder stands for all files below it."""
    bare = ~glob.contains("*") & ~F.regexp_replace(glob, "^.*/", "").contains(".")
    whole = F.when(bare, F.concat(F.regexp_replace(glob, "/+$", ""), F.lit("/**"))).otherwise(glob)
    out = F.regexp_replace(whole, r"([.+()\[\]{}^$|\\])", r"\\$1")
    # Wildcards, the longer ones first; marks keep what is done apart from what is to do.
    for mark, wild in (("\x01", r"\*\*/"), ("\x02", r"\*\*"), ("\x03", r"\*"), ("\x04", r"\?")):
        out = F.regexp_replace(out, wild, mark)
    for mark, text in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*"), ("\x04", "[^/]")):
        out = F.replace(out, F.lit(mark), F.lit(text))
    return F.concat(F.lit("^"), out, F.lit("$"))


def globs(config_rows: DataFrame) -> DataFrame:
    """(config, kind, head, pattern): include, exclude and files of configurations as rows, below their folders. head are the leading parts without a wildcard, pattern a regular expression.
    Without include and files a configuration takes all files below its folder; without exclude it leaves out installed packages and, below them, nothing else."""
    whole = F.array(F.lit("**/*"))
    given = F.map_from_arrays(
        F.array(F.lit("include"), F.lit("exclude"), F.lit("files")),
        F.array(F.coalesce("include", F.when(F.col("files").isNull(), whole).otherwise(F.array().cast("array<string>"))), F.coalesce("exclude", F.array(F.lit("**/node_modules/**"))), F.coalesce("files", F.array().cast("array<string>"))),
    )
    rows = config_rows.select(F.col("path").alias("config"), "config_dir", F.explode(given).alias("kind", "list")).select("config", "config_dir", "kind", F.explode("list").alias("glob"))
    wild = F.regexp_extract("glob", r"^([^*?]*/)?", 1)
    inner = plain_path(F.concat_ws("/", F.nullif("config_dir", F.lit("")), F.when(F.col("glob").rlike(r"[*?]"), wild).otherwise(F.col("glob"))))
    full = F.concat_ws("/", F.nullif(inner, F.lit("")), F.when(F.col("glob").rlike(r"[*?]"), F.regexp_replace("glob", r"^[^*?]*/", "")))
    return rows.select("config", "config_dir", "kind", inner.alias("head"), glob_column(full).alias("pattern"))


def owned(files: DataFrame, config_rows: DataFrame) -> DataFrame:
    """(path, config): for each file (path) the configuration that owns it: of those whose include or files take it and whose exclude doesn't, the one in the deepest folder, the leading
    name first. Every file meets only patterns that begin with its own leading parts, in an equi-join; files that are listed cannot be excluded."""
    rows = globs(config_rows)
    parts = F.split("path", "/")
    up = files.select("path").distinct().withColumn("head", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    hits = up.join(rows, "head").where((F.col("kind") == "files") & (F.col("path") == F.col("head")) | (F.col("kind") != "files") & F.expr("path rlike pattern"))
    kinds = hits.groupBy("path", "config", "config_dir").agg(F.collect_set("kind").alias("kinds"))
    has = lambda k: F.array_contains("kinds", k)
    name = F.regexp_replace("config", "^.*/", "")
    order = F.struct(-F.length("config_dir"), F.when(name == "tsconfig.json", 0).when(name == "jsconfig.json", 1).otherwise(2), F.col("config"))
    return kinds.where(has("files") | has("include") & ~has("exclude")).groupBy("path").agg(F.min_by("config", order).alias("config"))


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs and none of those that start with `!`."""
    hit = lambda globs: F.lit(False) if not globs else path.rlike("|".join(glob_regex(g if "*" in g or "." in g.split("/")[-1] else g.rstrip("/") + "/**") for g in globs))
    wanted = [p for p in patterns if not p.startswith("!")]
    return (hit(wanted) if wanted else F.lit(True)) & ~hit([p[1:] for p in patterns if p.startswith("!")])
