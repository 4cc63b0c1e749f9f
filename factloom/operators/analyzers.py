"""Analyzers over code facts, by registered name. Each takes facts (name -> DataFrame, see Facts) and parameters and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import in_excluded, is_test_file, squeezed, unquoted
from factloom.operators import binding, graph, relational
from factloom.sources import code_facts, names
from factloom.tables import durable, grown

#: Modules of the runtime that need no declaration.
BUILTINS = [
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os",
    "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "zlib",
]
#: Development packages that are used without an import.
TOOLS = [
    "eslint", "prettier", "husky", "lint-staged", "typescript", "vite", "vitest", "jest", "webpack", "stylelint", "commitlint", "@commitlint/cli", "@commitlint/config-conventional", "webpack-cli", "webpack-dev-server",
    "rollup", "@babel/core", "@babel/cli", "babel-loader", "ts-node", "nodemon", "react-scripts", "customize-cra", "react-app-rewired", "@vitejs/plugin-react", "vite-tsconfig-paths",
    "eslint-plugin-react", "eslint-plugin-import", "eslint-config-airbnb", "eslint-config-prettier", "@typescript-eslint/eslint-plugin", "@typescript-eslint/parser", "stylelint-config-standard", "postcss",
]
#: Fixed values of the classification of unreferenced files: parts of a path that leave a file out, beginnings of names that do, well-known entry points, and what makes a file under src suspicious.
IGNORED_PARTS = [".test.", ".spec.", "__tests__", "__mocks__", ".d.ts", ".story.", ".stories."]
CONFIG_NAMES = [
    "webpack.config", "vite.config", "rollup.config", "babel.config", "prettier.config", ".prettierrc", "eslint.config", ".eslintrc", "jest.config", "karma.conf", "gulpfile", "gruntfile",
    "tsconfig", "jsconfig", "postcss.config", "tailwind.config", "commitlint.config", ".commitlintrc", "lint-staged.config", "stylelint.config", ".stylelintrc", "nodemon.json", "nodemon-debug.json",
    "build.config", "vitest.config", "cypress.config", "playwright.config",
]
ENTRY_FILES = ["index.ts", "index.tsx", "main.ts", "main.tsx", "App.ts", "App.tsx", "src/index.ts", "src/index.tsx"]
ENTRY_NAMES = ["index.", "main.", "app.", "root.", "entry."]
CORE_WORDS = ["router", "route", "store", "state", "theme", "i18n", "locale", "config", "setting", "constant", "util", "helper", "service", "api", "http", "request", "axios", "fetch", "polyfill"]


class Facts(Mapping):
    """The facts of a project by name. Each is found when first asked for and written down, so that all analyzers that follow read tables."""

    NAMES = [
        "files", "code", "plain", "nodes", "imports", "re_exports", "exports", "calls", "jsx", "variables", "functions", "members", "type_refs", "symbols", "any", "as", "returns", "packages", "origins", "names", "bindings", "uses",
    ]

    def __init__(self, files: DataFrame, aliases: DataFrame):
        self._files, self._aliases, self._found = files, aliases, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self._found:
            # Code is written down as it is dealt.
            self._found[name] = code_facts.dealt(self._files) if name == "code" else durable(self._build(name), f"facts-{name}")
        return self._found[name]

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    def _build(self, name: str) -> DataFrame:
        resolved = lambda rows: code_facts.resolve(rows, self._files.select("path"), self._aliases)
        return {
            "files": lambda: self._files.drop("content"),
            "plain": lambda: code_facts.plain(self["code"]),
            "nodes": lambda: code_facts.nodes(self["code"]),
            "imports": lambda: resolved(code_facts.imports(self["plain"])),
            "re_exports": lambda: resolved(code_facts.re_exports(self["plain"])),
            "exports": lambda: code_facts.exports(self["plain"], self["nodes"]),
            "calls": lambda: code_facts.calls(self["nodes"]),
            "jsx": lambda: self._jsx(),
            "variables": lambda: code_facts.variables(self["nodes"]),
            "functions": lambda: code_facts.functions(self["nodes"]),
            "members": lambda: code_facts.type_members(self["nodes"]),
            "type_refs": lambda: code_facts.type_references(self["nodes"]),
            "symbols": lambda: code_facts.symbols(self["nodes"], self["exports"]),
            "any": lambda: code_facts.keywords(self["nodes"], "any"),
            "as": lambda: code_facts.keywords(self["nodes"], "as"),
            "returns": lambda: code_facts.keywords(self["nodes"], "return"),
            "packages": lambda: code_facts.packages(self._files.where("path = 'package.json' or path like '%/package.json'")),
            "origins": lambda: _origins(self),
            "names": lambda: names.names(self["code"]),
            "bindings": lambda: binding.bound_names(self["names"]),
            "uses": lambda: binding.resolved_uses(self["names"], self["bindings"]),
        }[name]()

    def _jsx(self) -> DataFrame:
        """Tags with the file that their first name is imported from."""
        tags = code_facts.jsx_elements(self["nodes"])
        source = self["imports"].where("identifier <> ''").groupBy("path", F.col("identifier").alias("head")).agg(F.min(F.struct("src_type", "src_path", "npm_pkg")).alias("s"))
        return tags.withColumn("head", F.element_at("chain", 1)).join(grown(source), ["path", "head"], "left").select("path", "line", "component", "chain", "attributes", "spread", "s.*")


def facts_of(files: DataFrame, aliases: DataFrame) -> Facts:
    """All facts of a project: files (path, content, ...), aliases as in code_facts.resolve()."""
    return Facts(files, aliases)


def file_edges(facts) -> DataFrame:
    """Edges from a file to the files that it imports, re-exports from or takes JSX components from. A tag's file is that of the import which brings its name in, so that imports hold these edges too."""
    both = facts["imports"].select("path", "src_path", "src_type").union(facts["re_exports"].select("path", "src_path", "src_type"))
    return graph.distinct_edges(both.where("src_type = 'file'").select(F.col("path").alias("src"), F.col("src_path").alias("dst")))


def external_deps(facts) -> DataFrame:
    """(path, packages): what each file takes from outside the project."""
    both = facts["imports"].select("path", "npm_pkg").union(facts["re_exports"].select("path", "npm_pkg")).where("npm_pkg is not null")
    return both.groupBy("path").agg(F.array_sort(F.collect_set("npm_pkg")).alias("packages"))


def count_any(facts) -> DataFrame:
    return relational.count_findings(facts["any"], "path", F.lit(True))


def count_as(facts) -> DataFrame:
    return relational.count_findings(facts["as"], "path", F.lit(True))


def finding_details(facts, kind: str) -> DataFrame:
    """(path, findings, details): the places of every `any` or `as`, in order."""
    return facts[kind].groupBy("path").agg(F.count("*").alias("findings"), F.array_sort(F.collect_list(F.struct("line", "column", "raw"))).alias("details"))


def finding_stats(facts, kind: str) -> DataFrame:
    """One row: files_parsed (all code files), files_with, total."""
    n = code_facts.code_files(facts["files"]).agg(F.count("*").alias("files_parsed"))
    return n.crossJoin(facts[kind].agg(F.count_distinct("path").alias("files_with"), F.count("*").alias("total")))


def _origins(facts) -> DataFrame:
    """(path, name, origin_path, origin_name): what a name of a file stands for, its own or taken over through any number of hops and stars.

    A file's own and named exports stand before starred ones, which are never taken over them; a name that stars bring from two different origins is ambiguous and not exported, here
    and wherever it would be taken on. One table keyed by (path, name, origin) grows by its frontier; every few rounds it is written anew, so that the lineage stays short.
    """
    hops = facts["re_exports"].where("src_type = 'file'").select("path", "name", "src_path", "origin_name")
    local = facts["exports"].select("path", "name").distinct()
    # A name imported and exported again by a braces list is a hop too.
    lists = facts["exports"].where("kind = 'list'").select("path", "name", F.col("local_name").alias("identifier"))
    through = lists.join(grown(facts["imports"].where("src_type = 'file' and module_type in ('named', 'default')")), ["path", "identifier"]).select("path", "name", "src_path", F.col("import_module").alias("origin_name"))
    hops = durable(hops.union(through).distinct(), "hops")
    own = local.join(through.select("path", "name"), ["path", "name"], "left_anti")
    named = durable(local.union(hops.where("name <> '*'").select("path", "name")).distinct(), "named-exports")
    known = durable(own.select("path", "name", F.col("path").alias("origin_path"), F.col("name").alias("origin_name")), "origins")
    fresh, rounds = known, 0
    direct, stars = hops.where("name <> '*'"), hops.where("name = '*'").select("path", "src_path")
    while True:
        k = grown(fresh.select(F.col("path").alias("src_path"), F.col("name").alias("n"), "origin_path", F.col("origin_name").alias("o")))
        by_name = direct.join(k.withColumnRenamed("n", "origin_name"), ["src_path", "origin_name"]).select("path", "name", "origin_path", F.col("o").alias("origin_name"))
        by_star = stars.join(k.where("n <> 'default'"), "src_path").select("path", F.col("n").alias("name"), "origin_path", F.col("o").alias("origin_name")).join(grown(named), ["path", "name"], "left_anti")
        step = by_name.union(by_star.select("path", "name", "origin_path", "origin_name")).distinct()
        fresh = durable(step.join(grown(known), ["path", "name", "origin_path", "origin_name"], "left_anti"), "origins")
        if fresh.isEmpty():
            break
        known, rounds = known.union(fresh), rounds + 1
        if rounds % 4 == 0:
            known = durable(known, "origins")
    single = known.groupBy("path", "name").agg(F.count("*").alias("n"), F.first("origin_path").alias("origin_path"), F.first("origin_name").alias("origin_name"))
    return single.where("n = 1").select("path", "name", "origin_path", "origin_name")


def re_export_stats(facts) -> DataFrame:
    """One row: files with re-exports, re-export rows, and names that they make available."""
    taken = facts["origins"].where("path <> origin_path").agg(F.count("*").alias("mappings"))
    return facts["re_exports"].agg(F.count_distinct("path").alias("files"), F.count("*").alias("re_exports")).crossJoin(taken)


def _consumed(facts) -> DataFrame:
    """(path, name) of exports that some import takes, directly or through re-exports; a namespace takes all names but the default."""
    taken = facts["imports"].where("src_type = 'file'").select(F.col("src_path").alias("path"), F.col("import_module").alias("name"), "module_type")
    taken = taken.withColumn("name", F.when(F.col("module_type").isin("dynamic", "dynamic_variable"), "default").otherwise(F.col("name")))
    by_name = taken.where("module_type <> 'namespace'").join(grown(facts["origins"]), ["path", "name"]).select(F.col("origin_path").alias("path"), F.col("origin_name").alias("name"))
    by_space = taken.where("module_type = 'namespace'").select("path").distinct().join(grown(facts["origins"]), "path").where("name <> 'default'").select(F.col("origin_path").alias("path"), F.col("origin_name").alias("name"))
    return by_name.union(by_space).distinct()


def unconsumed_exports(facts) -> DataFrame:
    """(path, name, kind, line) of exports that no import takes; tests and declaration files do not count as exporters."""
    own = facts["exports"].where(~is_test_file(F.col("path"))).select("path", "name", "kind", "line")
    return relational.unconsumed(own, _consumed(facts), ["path", "name"])


def unconsumed_stats(facts) -> DataFrame:
    """One row: files looked at, exports found, exports that nothing takes."""
    own = facts["exports"].where(~is_test_file(F.col("path")))
    n = code_facts.code_files(facts["files"]).where(~is_test_file(F.col("path"))).agg(F.count("*").alias("files"))
    return n.crossJoin(own.agg(F.count("*").alias("exports"))).crossJoin(unconsumed_exports(facts).agg(F.count("*").alias("unconsumed")))


def _any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def unreferenced_class(path: Column, excluded: list[str]) -> Column:
    """ignored, config, excluded, suspicious or unreferenced; the first rule that holds."""
    name, folders = F.element_at(F.split(path, "/"), -1), F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    suspicious = ~F.array_contains(folders, "src") | _any_of([name.startswith(x) for x in ENTRY_NAMES]) | _any_of([name.contains(x) for x in CORE_WORDS])
    return (
        F.when(_any_of([path.contains(x) for x in IGNORED_PARTS]), "ignored").when(_any_of([name.startswith(x) for x in CONFIG_NAMES]), "config")
        .when(in_excluded(path, excluded), "excluded").when(suspicious, "suspicious").otherwise("unreferenced")
    )


def unreferenced_files(facts, entrypoint: str = "", include_entry_dirs: bool = False, exclude: str = "") -> DataFrame:
    """(path, verdict): files that nothing refers to and that are no entry points. Entry points are those given (comma-separated), or with include_entry_dirs the well-known ones that
    exist at the top; where there are none, files that end like an index or main file count as such. (A file that is reached from an entry point is referred to, so no search is needed.)"""
    files = code_facts.code_files(facts["files"]).select("path")
    taken = [facts[n].where("src_type = 'file'").select(F.col("src_path").alias("path")) for n in ("imports", "re_exports", "jsx")]
    alone = files.join(taken[0].union(taken[1]).union(taken[2]).distinct(), "path", "left_anti")
    entries = [e.strip() for e in entrypoint.split(",") if e.strip()]
    if not entries and include_entry_dirs and not files.where(F.col("path").isin(ENTRY_FILES)).isEmpty():
        entries = ENTRY_FILES
    is_entry = F.col("path").isin(entries) if entries else _any_of([F.col("path").endswith(x) for x in ("index.ts", "index.tsx", "main.ts", "main.tsx")])
    return alone.where(~is_entry).withColumn("verdict", unreferenced_class(F.col("path"), [e.strip() for e in exclude.split(",") if e.strip()]))


def unreachable_files(facts, entrypoint: str, exclude: str = "", include_entry_dirs: bool = False) -> DataFrame:
    """(path, verdict): files that the entry points (comma-separated) don't reach, whether or not other files of that kind refer to them; with include_entry_dirs
    every file in an entry point's folder is one."""
    edges, files, entries = file_edges(facts), code_facts.code_files(facts["files"]).select("path"), [e.strip() for e in entrypoint.split(",")]
    chosen = F.col("path").isin(entries)
    if include_entry_dirs:
        chosen = chosen | F.regexp_replace("path", r"/?[^/]*$", "").isin([e.rpartition("/")[0] for e in entries])
    reached = graph.reach_levels(edges, files.where(chosen).select(F.col("path").alias("node")), None).select(F.col("node").alias("path"))
    return files.join(reached, "path", "left_anti").withColumn("verdict", unreferenced_class(F.col("path"), [e.strip() for e in exclude.split(",") if e.strip()]))


def dead_files(facts, entrypoint: str, exclude: str = "", include_entry_dirs: bool = False) -> DataFrame:
    """(path, verdict, referenced): unreachable_files(), and whether another file, which is dead too, refers to one. Those that none does are unreferenced_files(), for which a file that takes itself is referred to."""
    taken = file_edges(facts).select(F.col("dst").alias("path")).distinct().withColumn("referenced", F.lit(True))
    dead = unreachable_files(facts, entrypoint, exclude, include_entry_dirs).join(taken, "path", "left")
    return dead.select("path", "verdict", F.coalesce("referenced", F.lit(False)).alias("referenced"))


def unreferenced_stats(facts, **params) -> DataFrame:
    """One row: files, unreferenced ones, suspicious ones, and how many of these other dead files refer to; params as in dead_files()."""
    verdicts = dead_files(facts, **params)
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    of_dead = F.count(F.when(F.col("referenced") & F.col("verdict").isin("unreferenced", "suspicious"), 1)).alias("referenced")
    return code_facts.code_files(facts["files"]).agg(F.count("*").alias("files")).crossJoin(verdicts.agg(count("unreferenced"), count("suspicious"), of_dead))


def implicit_dependencies(facts) -> DataFrame:
    """(name, path, raw): every import of a package that no manifest declares."""
    used = facts["imports"].where("npm_pkg is not null").select(F.col("npm_pkg").alias("name"), "path", "raw").distinct()
    own = used.where(~F.col("name").isin(BUILTINS) & ~F.col("name").startswith("node:"))
    return own.join(facts["packages"].select("name").distinct(), "name", "left_anti")


def npm_check(facts, registry: DataFrame | None = None, installed: DataFrame | None = None) -> DataFrame:
    """(name, problem, detail): implicit, unused and (against a registry snapshot (name, latest)) outdated dependencies. installed: manifests (path, content) below node_modules, whose
    versions stand before the declared ones."""
    used = facts["imports"].where("npm_pkg is not null").select(F.col("npm_pkg").alias("name"))
    declared = facts["packages"].select("name", "path", "version")
    if installed is not None:
        declared = code_facts.installed_versions(declared, installed).select("name", "path", F.coalesce("installed", "version").alias("version"))
    implicit = relational.undeclared(used.where(~F.col("name").isin(BUILTINS) & ~F.col("name").startswith("node:")), declared.select("name").distinct(), "name")
    idle = relational.unused(declared.groupBy("name").agg(F.min("path").alias("path")), used, "name", F.col("name").isin(TOOLS) | F.col("name").startswith("@types/"))
    out = implicit.select("name", F.lit("implicit").alias("problem"), F.col("uses").cast("string").alias("detail")).union(idle.select("name", F.lit("unused"), "path"))
    if registry is not None:
        one = declared.groupBy("name").agg(F.min("version").alias("version"))
        old = relational.outdated(one, registry, "name", "version", "latest")
        out = out.union(old.select("name", F.lit("outdated"), F.concat_ws(" < ", "version", "latest")))
    return out


def package_list(facts) -> DataFrame:
    return facts["packages"]


def trace(facts, target_pkgs: str) -> DataFrame:
    """(path, symbol): names that come from the packages (comma-separated), through assignments and destructuring inside their file."""
    seeds = facts["imports"].where(F.col("npm_pkg").isin([p.strip() for p in target_pkgs.split(",")])).select("path", F.col("identifier").alias("node"))
    flow = facts["variables"].where("source is not null").select("path", F.element_at(F.split("source", r"\."), 1).alias("src"), F.col("identifier").alias("dst"))
    return graph.spread(flow, seeds.where("node <> ''"), ["path"]).withColumnRenamed("node", "symbol")


def trace_facts(facts, target_pkgs: str) -> DataFrame:
    """(path, fact, line, name): the imports, variables, calls and JSX tags that the traced names take part in."""
    marked = durable(trace(facts, target_pkgs), "traced")
    one = facts["imports"].where("identifier <> ''").select("path", F.lit("import").alias("fact"), F.lit(None).cast("int").alias("line"), F.col("identifier").alias("name"), F.col("identifier").alias("symbol"))
    two = facts["variables"].select("path", F.lit("variable"), "line", "identifier", F.col("identifier"))
    three = facts["calls"].select("path", F.lit("call"), "line", F.array_join("chain", "."), F.element_at("chain", 1))
    four = facts["jsx"].select("path", F.lit("jsx"), "line", "component", F.element_at("chain", 1))
    return one.union(two).union(three).union(four).join(marked, ["path", "symbol"], "left_semi").select("path", "fact", "line", "name")


def api_tracer(facts, api_paths: str) -> DataFrame:
    """(path, line, api): calls `x.fetch(path, ...)` of the given paths (comma-separated)."""
    api = unquoted(squeezed(F.col("argument")))
    hits = facts["calls"].where((F.size("chain") >= 2) & (F.element_at("chain", -1) == "fetch")).withColumn("api", api)
    return hits.where(F.col("api").isin([" ".join(p.split()) for p in api_paths.split(",")])).select("path", "line", "api")


def component_of(paths: DataFrame, components: DataFrame) -> DataFrame:
    """paths (path) with the component (name, root) whose root stands in the path, at its start or below other folders; the longest root counts."""
    found = relational.folder_at_any_depth(paths.select("path").distinct(), "path", components.select("root"), "root")
    return found.join(components.select("name", "root"), "root").select("path", F.col("name").alias("component"))


def component_edges(facts, components: DataFrame) -> DataFrame:
    """(src, dst, files): components that import from one another."""
    edges = file_edges(facts)
    owner = component_of(facts["files"], components)
    lifted = edges.join(owner.toDF("src", "a"), "src").join(owner.toDF("dst", "b"), "dst").where("a <> b")
    return lifted.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.array_sort(F.collect_set(F.col("src"))).alias("files"))


def symbol_imports(facts, components: DataFrame) -> DataFrame:
    """(src, dst, symbols): for each pair of components what one imports from the other: (name, type, from file, in file)."""
    owner = durable(component_of(facts["files"], components), "owners")
    taken = facts["imports"].where("src_type = 'file'").join(owner.toDF("path", "src"), "path").join(owner.toDF("src_path", "dst"), "src_path").where("src <> dst")
    return taken.groupBy("src", "dst").agg(F.array_sort(F.collect_set(F.struct(F.col("import_module").alias("name"), F.col("module_type").alias("type"), F.col("src_path").alias("from_file"), F.col("path").alias("in_file")))).alias("symbols"))


def component_deps(facts, components: DataFrame) -> DataFrame:
    """(component, files, components, packages, dependencies): what each component takes from other components and from npm.

    dependencies: one entry for each file or package that is imported, its modules merged over the component's files."""
    owner = durable(component_of(facts["files"], components), "owners")
    size = owner.groupBy("component").agg(F.count("*").alias("files"))
    npm = facts["imports"].where("npm_pkg is not null").join(owner, "path").groupBy("component").agg(F.array_sort(F.collect_set("npm_pkg")).alias("packages"))
    own = component_edges(facts, components).groupBy(F.col("src").alias("component")).agg(F.array_sort(F.collect_set("dst")).alias("components"))
    outer = facts["imports"].join(owner, "path").join(owner.toDF("src_path", "theirs"), "src_path", "left").where("theirs is null or theirs <> component")
    merged = outer.groupBy("component", F.coalesce("src_path", "npm_pkg").alias("key")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "module_type", "import_module", "identifier"))).alias("modules"))
    merged = merged.where("key is not null").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("key", "modules"))).alias("dependencies"))
    out = components.select(F.col("name").alias("component"))
    for part in (size, own, npm, merged):
        out = out.join(part, "component", "left")
    return out


def export_calls(facts, components: DataFrame) -> DataFrame:
    """(component, path, name, export_type, ref_files, ref_components): where each export of a component is imported, re-exports followed. A namespace import takes named exports only."""
    taken = facts["imports"].where("src_type = 'file'").select(F.col("path").alias("ref"), F.col("src_path").alias("path"), F.col("import_module").alias("taken"), "module_type")
    hits = taken.join(grown(facts["origins"]), "path").where((F.col("taken") == F.col("name")) | ((F.col("module_type") == "namespace") & (F.col("name") != "default")))
    owner = durable(component_of(facts["files"], components), "owners")
    refs = hits.select("ref", F.col("origin_path").alias("path"), F.col("origin_name").alias("name")).join(owner.toDF("ref", "ref_component"), "ref", "left")
    refs = refs.groupBy("path", "name").agg(F.array_sort(F.collect_set("ref")).alias("ref_files"), F.array_sort(F.collect_set("ref_component")).alias("ref_components"))
    own = facts["exports"].select("path", "name", "export_type").distinct().join(owner, "path")
    none = F.array().cast("array<string>")
    return own.join(refs, ["path", "name"], "left").select("component", "path", "name", "export_type", F.coalesce("ref_files", none).alias("ref_files"), F.coalesce("ref_components", none).alias("ref_components"))


def export_modules(facts, components: DataFrame) -> DataFrame:
    """(component, modules): export_calls() nested as component, file, exports, each in order."""
    rows = export_calls(facts, components).groupBy("component", "path").agg(F.array_sort(F.collect_list(F.struct("name", "export_type", "ref_files", "ref_components"))).alias("nodes"))
    return rows.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("path", "nodes"))).alias("modules"))


def changed_symbols(facts, changed: DataFrame) -> DataFrame:
    """(path, name, kind, exported, export_type, lines): declarations that changed lines (path, line) fall into."""
    hit = relational.inside_interval(changed, facts["symbols"], ["path"], "line", "start_line", "end_line")
    return hit.groupBy("path", "name", "kind", "exported", "export_type").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def css_files(facts) -> DataFrame:
    return code_facts.listed(facts["files"], code_facts.CSS)


def markdown_files(facts) -> DataFrame:
    return code_facts.listed(facts["files"], code_facts.MARKDOWN)


def _impact(name: str):
    def run(facts, *given, **params):
        from factloom.operators import impact

        return getattr(impact, name)(facts, *given, **params)

    return run


file_impact, component_impact, mr_impact, find_callers = (_impact(n) for n in ("file_impact", "component_impact", "mr_impact", "find_callers"))

REGISTRY = {
    "count-any": count_any, "count-as": count_as, "unconsumed": unconsumed_exports, "find-unreferenced-files": unreferenced_files, "npm-check": npm_check, "pkg-deps": package_list,
    "trace": trace, "api-tracer": api_tracer, "component-deps": component_deps, "export-call": export_calls, "css-file": css_files, "md-file": markdown_files, "find-callers": find_callers,
    "file-impact": file_impact, "component-impact": component_impact, "mr-impact": mr_impact, "symbols": changed_symbols,
}


def analyze(names: list[str], facts, params: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Several analyzers over one set of facts."""
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown analyzers: {', '.join(unknown)}; known: {', '.join(REGISTRY)}")
    return {n: REGISTRY[n](facts, **(params or {}).get(n, {})) for n in names}


def first_importers(facts) -> DataFrame:
    """(src_path, name, path): for each imported name the first file, by path, that imports it."""
    taken = facts["imports"].where("src_type = 'file'").select("src_path", F.col("import_module").alias("name"), "path")
    return taken.withColumn("r", F.row_number().over(Window.partitionBy("src_path", "name").orderBy("path"))).where("r = 1").drop("r")
