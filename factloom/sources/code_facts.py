"""Facts of TypeScript and JavaScript files as tables.

A file's nodes (see outline.py) are read once, one file at a time inside Spark tasks; all facts are selections of them, or of Spark's own regular
expressions over the text without comments. Resolution and everything else is joins. Source lines and columns are 1-based.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import any_suffix, base_name, default_export_name, extension, file_kind, folder_of, format_size, glob_regex, package_name
from factloom.sources import outline, readers
from factloom.sources.tokens import Tokens
from factloom.tables import durable, grown

#: Globs that the scanner and the parser leave out, code and other suffixes, and what an import may leave out, in the order tried.
SCAN_IGNORED = ["node_modules/**/*", ".git/**/*", "**/__test__/**", "**/*.test.{ts,tsx,js,jsx}"]
PARSE_IGNORED = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/test/**", "**/public/**", "**/static/**"]
CODE = [".ts", ".tsx", ".js", ".jsx"]
LEFT_OUT = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx"]
CSS, MARKDOWN = [".css", ".less", ".scss", ".sass"], [".md", ".mdx"]
DECLARATIONS = ["function", "class", "interface", "type", "enum", "variable"]
#: Letters of text that a task parses, and rows of a batch that it gives.
PART_LETTERS, BATCH_ROWS = 1 << 20, 20_000
_NODE = "path string, id int, parent int, depth int, kind string, name string, pos int, end int, start_line int, end_line int, start_column int, exported boolean, text string, more map<string,string>"


def scan(spark, root: str, ignored: list[str] = SCAN_IGNORED) -> DataFrame:
    """(path, file_name, ext, file_type, size_bytes, size_text, content) of the files below root; path is relative. Ignored folders are never listed, and tasks list the others (see readers.py)."""
    files = readers.source_tree(spark, root, ignored)
    return files.select("path", base_name(F.col("path")).alias("file_name"), extension(F.col("path")).alias("ext"), file_kind(F.col("path")).alias("file_type"), "size_bytes", format_size(F.col("size_bytes")).alias("size_text"), "content")


def scan_project(spark, root: str) -> DataFrame:
    """The files that a parse takes: scan() without built, public, static and test folders."""
    return scan(spark, root, SCAN_IGNORED + PARSE_IGNORED)


def parsed_files(files: DataFrame, ignored: list[str] = PARSE_IGNORED) -> DataFrame:
    """files without those that a project parse leaves out."""
    keep = F.lit(True)
    for g in ignored:
        keep = keep & ~F.col("path").rlike(glob_regex(g))
    return files.where(keep)


def code_files(files: DataFrame) -> DataFrame:
    return files.where(any_suffix(F.col("path"), CODE))


def dealt(files: DataFrame) -> DataFrame:
    """(path, content) of the code files, dealt by path into parts of about PART_LETTERS and written down. Source text is small for the work that it takes: a table of it has few row
    groups, and a task reads a whole one."""
    code = code_files(files).select("path", "content")
    letters = code.agg(F.sum(F.length("content"))).first()[0] or 0
    return durable(code.repartition(letters // PART_LETTERS + 1, "path"), "code")


def listed(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Style sheets or Markdown files: only their paths carry information."""
    return files.where(any_suffix(F.col("path"), suffixes)).select("path")


def nodes(files: DataFrame) -> DataFrame:
    """One row per node of every file: kind, name, extent, the id of the declaration around it (parent, -1 at the top), and what is particular to its kind (more)."""

    names = [f.split()[0] for f in _NODE.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}.get(f.split()[1], pa.map_(pa.string(), pa.string()))) for n, f in zip(names, _NODE.split(", "))])

    def run(it):
        made = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
        for batch in it:
            columns = [[] for _ in names]
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n in outline.nodes(content or "", not path.endswith(".ts")):
                    n["path"], n["more"] = path, list(n["more"].items())
                    for column, name in zip(columns, names):
                        column.append(n[name])
                if len(columns[0]) >= BATCH_ROWS:
                    yield made(columns)
                    columns = [[] for _ in names]
            yield made(columns)

    return files.select("path", "content").mapInArrow(run, _NODE)


def plain(files: DataFrame) -> DataFrame:
    """(path, content): comments blanked, positions kept."""

    def run(it):
        for batch in it:
            texts = [Tokens(t or "", not p.endswith(".ts")).blanked(strings=False) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content string")


def _found(files: DataFrame, pattern: str) -> DataFrame:
    every = F.expr(f"regexp_extract_all(content, r'{pattern}', 0)")
    return files.select("path", F.posexplode(every).alias("decl_idx", "raw"))


def _names(text: Column) -> Column:
    """Names of a braces list: (module, identifier), `a as b` split."""
    entries = F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^type ", "")), lambda x: x != "")
    return F.transform(entries, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("module"), F.regexp_extract(x, r"(\S+)$", 1).alias("identifier")))


_MODULE = "array<struct<import_module:string,module_type:string,identifier:string>>"


def imports(plain_files: DataFrame) -> DataFrame:
    """(path, decl_idx, import_module, module_type, identifier, specifier, raw). Side-effect imports have one row of type side_effect, `import()` one of type dynamic (dynamic_variable where a variable takes it)."""
    rows = _found(plain_files, r"(?m)(?:^|;)[ \t]*import\b(?!\s*[(.])[^;=(]*?[\x22\x27][^\x22\x27\n]+[\x22\x27]").withColumn("raw", F.regexp_replace("raw", r"^[;\s]+", ""))
    rows = rows.withColumn("specifier", F.regexp_extract("raw", "[\"']([^\"']+)[\"']$", 1))
    rows = rows.withColumn("head", F.regexp_extract("raw", r"(?s)import\s+(?:type\s+)?(.*?)\s*from\s*[\"']", 1))
    named = F.transform(_names(F.regexp_extract("head", r"(?s)\{(.*)\}", 1)), lambda x: F.struct(x.module.alias("import_module"), F.when(x.module == "default", "default").otherwise("named").alias("module_type"), x.identifier.alias("identifier")))
    space, default = F.regexp_extract("head", r"\*\s+as\s+([\w$]+)", 1), F.regexp_extract("head", r"^([\w$]+)", 1)

    def one(name: Column, module: str, kind: str) -> Column:
        entry = F.struct(F.lit(module).alias("import_module"), F.lit(kind).alias("module_type"), name.alias("identifier"))
        return F.when(name != "", F.array(entry)).otherwise(F.array().cast(_MODULE))

    found = F.concat(one(default, "default", "default"), one(space, "*", "namespace"), named)
    nothing = F.array(F.struct(F.lit("").alias("import_module"), F.lit("side_effect").alias("module_type"), F.lit("").alias("identifier")))
    rows = rows.select("path", "decl_idx", F.explode(F.when(F.size(found) > 0, found).otherwise(nothing)).alias("m"), "specifier", "raw")
    lazy = _found(plain_files.where(F.col("content").contains("import(")), r"(?:(?:const|let|var)\s+[\w$]+\s*=\s*(?:await\s+)?)?import\(\s*[\x22\x27][^\x22\x27]+[\x22\x27]\s*\)")
    variable = F.regexp_extract("raw", r"(?:const|let|var)\s+([\w$]+)", 1)
    lazy = lazy.select(
        "path", (F.col("decl_idx") + 1_000_000).alias("decl_idx"), F.lit("default").alias("import_module"), F.when(variable == "", "dynamic").otherwise("dynamic_variable").alias("module_type"),
        F.when(variable == "", "default").otherwise(variable).alias("identifier"), F.regexp_extract("raw", "[\"']([^\"']+)[\"']", 1).alias("specifier"), "raw",
    )
    return rows.select("path", "decl_idx", "m.*", "specifier", "raw").unionByName(lazy)


def re_exports(plain_files: DataFrame) -> DataFrame:
    """(path, name, origin_name, export_type, specifier): names taken over from another module; `*` for all of them."""
    rows = _found(plain_files, r"(?m)^[ \t]*export\s[^;{]*?(?:\{[^}]*\}\s*)?from\s*[\x22\x27][^\x22\x27\n]+[\x22\x27]").withColumn("specifier", F.regexp_extract("raw", "[\"']([^\"']+)[\"']$", 1))
    star = F.array(F.struct(F.lit("*").alias("module"), F.coalesce(F.nullif(F.regexp_extract("raw", r"\*\s+as\s+([\w$]+)", 1), F.lit("")), F.lit("*")).alias("identifier")))
    is_star = F.col("raw").rlike(r"export\s+(type\s+)?\*")
    rows = rows.select("path", "specifier", is_star.alias("star"), F.explode(F.when(is_star, star).otherwise(_names(F.regexp_extract("raw", r"(?s)\{(.*)\}", 1)))).alias("m"))
    kind = F.when(F.col("star"), "namespace").when(F.col("m.identifier") == "default", "default").otherwise("named")
    return rows.select("path", F.col("m.identifier").alias("name"), F.col("m.module").alias("origin_name"), kind.alias("export_type"), "specifier")


def exports(plain_files: DataFrame, node_rows: DataFrame) -> DataFrame:
    """(path, name, kind, export_type, local_name, line): local exports of declarations, braces lists and the default; one row for each (path, name), declarations and defaults before lists."""
    top = node_rows.where(F.col("exported") & F.col("kind").isin(DECLARATIONS))
    by_default = F.coalesce(F.col("more")["default"], F.lit("false")) == "true"
    declared = top.select("path", F.when(by_default, "default").otherwise(F.col("name")).alias("name"), F.when(by_default, "default").otherwise(F.col("kind")).alias("kind"), F.col("name").alias("local_name"), F.col("start_line").alias("line"), F.lit(0).alias("source"))
    default = lines(plain_files).where(F.col("text").rlike(r"^\s*export\s+default\b")).select("path", F.lit("default").alias("name"), F.lit("default").alias("kind"), default_export_name(F.col("text")).alias("local_name"), "line", F.lit(1).alias("source"))
    lists = _found(plain_files, r"(?m)^[ \t]*export\s+(?:type\s+)?\{[^}]*\}(?!\s*from)").select("path", F.explode(_names(F.regexp_extract("raw", r"(?s)\{(.*)\}", 1))).alias("m"))
    lists = lists.select("path", F.col("m.identifier").alias("name"), F.lit("list").alias("kind"), F.col("m.module").alias("local_name"), F.lit(None).cast("int").alias("line"), F.lit(2).alias("source"))
    rows = declared.union(default).union(lists).groupBy("path", "name").agg(F.min_by(F.struct("kind", "local_name", "line"), "source").alias("s"))
    return rows.select("path", "name", "s.kind", F.when(F.col("name") == "default", "default").otherwise("named").alias("export_type"), "s.local_name", "s.line")


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def calls(node_rows: DataFrame) -> DataFrame:
    """(path, line, chain, argument): call chains such as a.b.c, whose head may be any text, and the raw first argument."""
    return node_rows.where("kind = 'call'").select("path", F.col("start_line").alias("line"), F.split(F.col("more")["chain"], "\x1f").alias("chain"), F.col("more")["argument"].alias("argument"))


def jsx_elements(node_rows: DataFrame) -> DataFrame:
    """(path, line, component, chain, attributes, spread)."""
    listed_ = lambda k: F.filter(F.split(F.col("more")[k], ","), lambda x: x != "")
    return node_rows.where("kind = 'jsx'").select("path", F.col("start_line").alias("line"), F.col("name").alias("component"), F.split("name", r"\.").alias("chain"), listed_("attributes").alias("attributes"), listed_("spread").alias("spread"))


def keywords(node_rows: DataFrame, kind: str) -> DataFrame:
    """(path, line, column, raw) of `any` keywords, `as` assertions or returns."""
    return node_rows.where(F.col("kind") == kind).select("path", F.col("start_line").alias("line"), F.col("start_column").alias("column"), F.col("text").alias("raw"))


def variables(node_rows: DataFrame) -> DataFrame:
    """(path, line, identifier, source, declared, type): every bound name, destructured ones too; source is the name on the right where there is just one."""
    m = F.col("more")
    return node_rows.where("kind = 'variable'").select("path", F.col("start_line").alias("line"), F.col("name").alias("identifier"), F.nullif(m["source"], F.lit("")).alias("source"), m["declared"].alias("declared"), m["type"].alias("type"))


def functions(node_rows: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line, exported, is_default, returns, parameters): declarations, and variables that hold a function."""
    m = F.col("more")
    own = node_rows.where((F.col("kind") == "function") | ((F.col("kind") == "variable") & (m["function"] == "true")))
    own = own.select("path", "id", "name", "start_line", "end_line", "exported", (F.coalesce(m["default"], F.lit("false")) == "true").alias("is_default"), F.coalesce(m["returns"], F.lit("")).alias("returns"))
    given = node_rows.where("kind = 'parameter'").select("path", F.col("parent").alias("id"), F.struct(F.col("id").alias("nth"), "name", m["type"].alias("type"), (m["optional"] == "true").alias("optional"), (m["rest"] == "true").alias("rest"), m["default"].alias("default")).alias("p"))
    given = given.groupBy("path", "id").agg(F.array_sort(F.collect_list("p")).alias("parameters"))
    return own.join(grown(given), ["path", "id"], "left").drop("id")


def type_members(node_rows: DataFrame) -> DataFrame:
    """(path, type, member, text) of interfaces and object types."""
    inner = node_rows.where("kind = 'member'").select("path", F.col("parent").alias("id"), F.col("name").alias("member"), F.col("more")["type"].alias("text"))
    return inner.join(grown(_types(node_rows)), ["path", "id"]).select("path", "type", "member", "text")


def type_references(node_rows: DataFrame) -> DataFrame:
    """(path, type, reference, places): which other types an interface, class or alias refers to, and where ('' for the alias itself, `extends`, or a member)."""
    inner = node_rows.where("kind = 'reference'").select("path", F.col("parent").alias("id"), F.col("name").alias("reference"), F.col("more")["place"].alias("place"))
    return inner.join(grown(_types(node_rows)), ["path", "id"]).groupBy("path", "type", "reference").agg(F.array_sort(F.collect_set("place")).alias("places"))


def _types(node_rows: DataFrame) -> DataFrame:
    return node_rows.where("kind in ('interface', 'type', 'class')").select("path", "id", F.col("name").alias("type"))


def symbols(node_rows: DataFrame, export_rows: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, end_line, exported, export_type): functions, classes, interfaces, types and enums at any depth, and top-level variables."""
    own = node_rows.where(F.col("kind").isin(DECLARATIONS) & ((F.col("kind") != "variable") | (F.col("parent") == -1) | (F.col("depth") == 0) | F.col("exported"))).where("name <> ''")
    out = export_rows.select("path", F.col("local_name").alias("name"), "export_type").groupBy("path", "name").agg(F.min("export_type").alias("export_type"))
    return own.join(grown(out), ["path", "name"], "left").select("path", "name", "kind", "start_line", "end_line", F.col("export_type").isNotNull().alias("exported"), "export_type")


def stems(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, specifier, rank, stem): the paths, without what an import may leave out, that each wanted (path, specifier) may mean, the least rank first.

    aliases (alias, target), or (config_dir, alias, target) for those of the nearest configuration: a specifier that is `alias` or starts with `alias/` is
    looked up below target, the longest alias first (a null config_dir: those of every file); the empty alias is a base folder, below which bare specifiers are tried last. Aliases meet the specifier's own leading parts in an
    equi-join; those that hold for every file are as few as one configuration has, and are broadcast, not the specifiers."""
    wanted = wanted.select("path", "specifier").distinct()
    near = wanted.where(F.col("specifier").startswith(".")).withColumn("stem", F.concat_ws("/", F.nullif(folder_of(F.col("path")), F.lit("")), "specifier")).withColumn("rank", F.lit(0))
    bare = wanted.where(~F.col("specifier").startswith("."))
    parts = F.split("specifier", "/")
    heads = bare.withColumn("alias", F.explode(F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.lit(""))))
    rest = F.when(F.col("alias") == "", F.col("specifier")).otherwise(F.expr("substring(specifier, length(alias) + 2)"))
    if "config_dir" in aliases.columns:
        from factloom.sources.tsconfig import nearest

        # Aliases without a configuration hold everywhere.
        own, everywhere = aliases.where("config_dir is not null"), aliases.where("config_dir is null").drop("config_dir")
        far = nearest(heads, own.select("config_dir").distinct()).join(own, ["config_dir", "alias"]).drop("config_dir").unionByName(heads.join(F.broadcast(everywhere), "alias"))
    else:
        far = heads.join(F.broadcast(aliases), "alias")
    far = far.withColumn("stem", F.concat_ws("/", F.nullif("target", F.lit("")), F.nullif(rest, F.lit("")))).withColumn("rank", F.when(F.col("alias") == "", 1).otherwise(-F.length("alias")))
    return near.select("path", "specifier", "rank", "stem").union(far.select("path", "specifier", "rank", "stem")).withColumn("stem", plain_path(F.col("stem")))


def candidates(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, specifier, rank, nth, src_path): the files that each wanted (path, specifier) may mean, the least (rank, nth) first; aliases as in stems()."""
    return stems(wanted, aliases).select("path", "specifier", "rank", F.posexplode(F.array(*[F.concat("stem", F.lit(e)) for e in LEFT_OUT])).alias("nth", "src_path"))


def by_stem(files: DataFrame) -> DataFrame:
    """(stem, nth, src_path): the first file, in the order of LEFT_OUT, that each stem may mean. Every file has two or three stems, so that specifiers meet them once and not once for each candidate."""
    path = F.col("path")
    own = F.array(*[F.when(path.endswith(e), F.struct(path.substr(F.lit(1), F.length(path) - len(e)).alias("stem"), F.lit(n).alias("nth"))) for n, e in enumerate(LEFT_OUT)])
    each = files.select("path", F.explode(F.array_compact(own)).alias("s")).select("path", "s.*")
    return each.groupBy("stem").agg(F.min("nth").alias("nth"), F.min_by("path", "nth").alias("src_path"))


def first_existing(tried: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, src_path): the first candidate of each specifier that is a file."""
    hit = tried.join(grown(files.select(F.col("path").alias("src_path"))), "src_path")
    return hit.groupBy("path", "specifier").agg(F.min_by("src_path", F.struct("rank", "nth")).alias("src_path"))


def with_sources(facts: DataFrame, found: DataFrame) -> DataFrame:
    """facts (path, specifier, ...) with src_type, src_path and npm_pkg, by found (path, specifier, src_path)."""
    out = facts.join(found, ["path", "specifier"], "left")
    npm = F.col("src_path").isNull()
    out = out.withColumn("npm_pkg", F.when(npm & ~F.col("specifier").startswith("."), package_name(F.col("specifier")))).withColumn("src_type", F.when(npm, "npm").otherwise("file"))
    return out.select(*facts.columns, "src_path", "npm_pkg", "src_type")


def resolve(facts: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts (path, specifier, ...) with src_type, src_path and npm_pkg; aliases as in stems()."""
    # Made once: the specifiers and the rows are both read off it.
    facts = durable(facts, "unresolved")
    hit = stems(facts, aliases).join(grown(by_stem(files)), "stem")
    return with_sources(facts, hit.groupBy("path", "specifier").agg(F.min_by("src_path", F.struct("rank", "nth")).alias("src_path")))


def plain_path(path: Column) -> Column:
    """`.` and `..` taken out."""
    step = lambda done, part: F.when((part == ".") | (part == ""), done).when(part == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).otherwise(F.concat(done, F.array(part)))
    odd = path.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(~odd, path).otherwise(F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def packages(manifests: DataFrame) -> DataFrame:
    """(workspace, path, name, dep_type, version) of package.json files (path, content): of one name in several lists the last list counts."""
    kinds = ["dependencies", "devDependencies", "peerDependencies"]
    parsed = manifests.withColumn("j", F.from_json("content", "struct<" + ",".join(f"{k}:map<string,string>" for k in kinds) + ">"))
    parsed = parsed.withColumn("workspace", F.when(folder_of(F.col("path")) == "", "root").otherwise(base_name(folder_of(F.col("path")))))
    rows = None
    for rank, kind in enumerate(kinds):
        one = parsed.select("workspace", "path", F.explode(F.col("j")[kind]).alias("name", "version"), F.lit(kind).alias("dep_type"), F.lit(rank).alias("rank"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("workspace", "path", "name").agg(F.max_by("version", "rank").alias("version"), F.max_by("dep_type", "rank").alias("dep_type"))


def installed_versions(package_rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """package_rows with the version installed below node_modules (manifests (path, content) of a scan that keeps them), null where there is none."""
    own = manifests.where(F.col("path").rlike(r"(^|/)node_modules/(@[^/]+/)?[^/]+/package\.json$"))
    own = own.select(F.regexp_extract("path", r"node_modules/((?:@[^/]+/)?[^/]+)/package\.json$", 1).alias("name"), F.get_json_object("content", "$.version").alias("installed"))
    return package_rows.join(own.groupBy("name").agg(F.min("installed").alias("installed")), "name", "left")
