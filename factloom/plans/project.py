"""Queries that run the analyzers on a project made from the driver's tables, with the same questions in SQL on these tables.

Every part is a source file: it imports the parts that follow it in some order line, declares a value, an interface and (some) a function, uses a
package, and so on; brands are folders and components. The files are read, resolved and analysed like any others; the SQL knows only the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import analyzers, binding, bundle, graph, impact, navigation, results
from factloom.plans.catalog import _PARTS, _part_edges
from factloom.sources import tsconfig
from factloom.tables import CLEANED, durable, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_MADE: dict[tuple, analyzers.Facts] = {}

_CONFIG = """{ // aliases of the project
  "extends": "./tsconfig.base.json", "compilerOptions": { "paths": { "@/*": ["src/*"], }, },
}"""
_PACKAGE = '{"name": "parts", "dependencies": {' + ", ".join(f'"pkg-{n}": "1.{n}.0"' for n in range(1, 46)) + ', "left-pad": "1.0.0", "old-lib": "2.0.0"}, "devDependencies": {"eslint": "9.0.0", "@types/node": "22.0.0"}}'


def _folder(brand: str) -> str:
    return f"concat('src/b', regexp_replace({brand}, '[^0-9]', ''))"


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content, size_bytes) of the project."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr(_folder("p_brand")).alias("folder"), F.col("p_size").alias("size"))
    other = part.select(F.col("k").alias("dst"), F.col("folder").alias("there"), F.col("size").alias("s"))
    near = F.expr("concat('../', substring(there, 5), '/p', dst)")
    line = F.when(F.col("s") % 2 == 1, F.expr("concat('import { v', dst, ', T', dst, ' } from \"@/', substring(there, 5), '/p', dst, '\"')")).otherwise(F.concat(F.expr("concat('import { v', dst, ', T', dst, ' } from ''')"), near, F.lit("'")))
    taken = _part_edges(spark, d).join(other, "dst").groupBy(F.col("src").alias("k")).agg(F.array_sort(F.collect_list(F.struct("dst", line.alias("line")))).alias("taken"))
    own = part.join(taken, "k", "left").withColumn("taken", F.coalesce("taken", F.expr("array()").cast("array<struct<dst:bigint,line:string>>")))
    heads = F.array_join(F.transform("taken", lambda t: t["line"]), "\n")
    members = F.array_join(F.transform("taken", lambda t: F.concat(F.lit("  m"), t["dst"].cast("string"), F.lit(": T"), t["dst"].cast("string"))), "\n")
    text = F.concat_ws(
        "\n", F.lit("// any comment: any, (x as any)"), heads, F.expr("concat('import { x } from ''pkg-', size, '''')"), F.expr("concat('export const v', k, ' = ', size)"),
        F.concat(F.expr("concat('export interface T', k, ' {\\n')"), members, F.lit("\n}")), F.expr("concat('const y', k, ' = x')"), F.expr("concat('const z', k, ' = y', k)"),
        F.expr("case when size % 3 = 0 then concat('export function f', k, '(x: any) {\\n  return v', k, ' as number\\n}') end"),
        F.expr("case when size % 7 = 0 then 'api.fetch(\"/parts/list\", 1)' end"), F.lit("const text = 'y as any'"),
    )
    code = own.select(F.expr("concat(folder, '/p', k, '.ts')").alias("path"), text.alias("content"))
    barrels = part.groupBy("folder").agg(F.min("k").alias("a"), F.max("k").alias("b")).select(F.expr("concat(folder, '/index.ts')").alias("path"), F.expr("concat('export * from ''./p', a, '''\\nexport { v', b, ' as last } from ''./p', b, '''\\n')").alias("content"))
    top = part.groupBy("folder").agg(F.lit(1)).select("folder").withColumn("line", F.expr("concat('import { last as l', substring(folder, 6), ' } from ''@/', substring(folder, 5), '''')"))
    main = top.groupBy().agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("content")).select(F.lit("src/main.ts").alias("path"), F.concat("content", F.lit("\nimport './p.css'\n")).alias("content"))
    fixed = spark.createDataFrame([("package.json", _PACKAGE), ("tsconfig.json", _CONFIG), ("tsconfig.base.json", '{"compilerOptions": {"baseUrl": "."}}'), ("src/p.css", "a {}"), ("README.md", "# parts")], "path string, content string")
    return code.union(barrels).union(main).union(fixed).withColumn("size_bytes", F.length("content"))


def facts(spark: SparkSession, d: str) -> analyzers.Facts:
    """The facts of the project; found once a session and folder, and again after cleanup()."""
    key = (spark.sparkContext.applicationId, CLEANED[0], d)
    if key not in _MADE:
        own = durable(files(spark, d), "project")
        merged = tsconfig.merged(tsconfig.configs(own))
        _MADE[key] = analyzers.Facts(own, tsconfig.aliases(merged.where("path = 'tsconfig.json'")))
    return _MADE[key]


def forget() -> None:
    """Drop the facts found so far, for timing."""
    _MADE.clear()


def components(spark: SparkSession, d: str) -> DataFrame:
    folder = F.expr(_folder("p_brand"))
    return table(spark, d, "part").select(F.substring(folder, 5, 9).alias("name"), folder.alias("root")).distinct()


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = "with recursive " + _BASE + " " + sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_BASE = f"""{_PARTS}, f as (select p_partkey as k, 'src/b' || regexp_replace(p_brand, '[^0-9]', '', 'g') as folder, p_size as size,
    'src/b' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '/p' || p_partkey || '.ts' as path from part),
    ends as (select folder, min(k) as a, max(k) as b from f group by 1),
    -- where things stand in a file: h lines of imports, as many of members (one empty line where there are none)
    w as (select f.*, greatest((select count(*) from edges where src = k), 1)::int as h from f),
    fe as (select a.path as src, b.path as dst from edges join f a on a.k = src join f b on b.k = dst
        union select folder || '/index.ts', folder || '/p' || a || '.ts' from ends union select folder || '/index.ts', folder || '/p' || b || '.ts' from ends
        union select 'src/main.ts', folder || '/index.ts' from ends union select 'src/main.ts', 'src/p.css'),
    owner as (select path, folder[5:] as c from f union select folder || '/index.ts', folder[5:] from ends),
    ce as (select distinct a.c as src, b.c as dst from fe join owner a on a.path = src join owner b on b.path = dst where a.c <> b.c)"""


@_query("select path, cast(1 as bigint) as findings from f where size % 3 = 0")
def project_count_any(spark, d):
    return analyzers.count_any(facts(spark, d))


@_query("select path, cast(1 as bigint) as findings from f where size % 3 = 0")
def project_count_as(spark, d):
    return analyzers.count_as(facts(spark, d))


@_query("""select (select count(*) from f) + (select count(*) from ends) + 1 as files_parsed, count(*) as files_with, count(*) as total from f where size % 3 = 0""")
def project_count_stats(spark, d):
    return results.run("count-any", facts(spark, d)).stats


@_query("""select src as path, dst as src_path, 'file' as src_type, cast(null as varchar) as npm_pkg, count(*) as names from (
        select a.path as src, b.path as dst from edges join f a on a.k = src join f b on b.k = dst union all select a.path, b.path from edges join f a on a.k = src join f b on b.k = dst
        union all select 'src/main.ts', folder || '/index.ts' from ends) group by 1, 2 union all select 'src/main.ts', null, 'file', null, 0 where false
    union all select path, null, 'npm', 'pkg-' || size, 1 from f""")
def project_imports(spark, d):
    own = facts(spark, d)["imports"].where("module_type <> 'side_effect'")
    return own.groupBy("path", "src_path", "src_type", "npm_pkg").agg(F.count("*").alias("names"))


@_query("""select path, name, kind from (
        select path, 'v' || k as name, 'variable' as kind, k in (select dst from edges) or k in (select b from ends) as used from f
        union all select path, 'T' || k, 'interface', k in (select dst from edges) from f
        union all select path, 'f' || k, 'function', false from f where size % 3 = 0) where not used""")
def project_unconsumed(spark, d):
    return analyzers.unconsumed_exports(facts(spark, d)).select("path", "name", "kind")


@_query("""select (select count(*) from f) + (select count(*) from ends) + 1 as files, (select count(*) * 2 from f) + (select count(*) from f where size % 3 = 0) as exports,
    (select count(*) from f where k not in (select dst from edges) and k not in (select b from ends)) + (select count(*) from f where k not in (select dst from edges))
    + (select count(*) from f where size % 3 = 0) as unconsumed""")
def project_unconsumed_stats(spark, d):
    return analyzers.unconsumed_stats(facts(spark, d))


@_query("select distinct src, dst from fe where src <> dst")
def project_file_edges(spark, d):
    return analyzers.file_edges(facts(spark, d))


@_query("select path, ['pkg-' || size] as packages from f")
def project_external_deps(spark, d):
    return analyzers.external_deps(facts(spark, d))


@_query(""", walk(path) as (select 'src/main.ts' union select dst from walk join fe on path = src)
    select path, 'unreferenced' as verdict from f where path not in (select path from walk)""")
def project_unreachable(spark, d):
    return analyzers.unreachable_files(facts(spark, d), "src/main.ts")


@_query(""", walk(path) as (select 'src/main.ts' union select dst from walk join fe on path = src)
    select path, 'unreferenced' as verdict, path in (select dst from fe where src <> dst) as referenced from f where path not in (select path from walk)""")
def project_unreferenced(spark, d):
    """What the main file does not reach; of these, what other dead files refer to."""
    return analyzers.dead_files(facts(spark, d), entrypoint="src/main.ts")


@_query(""", walk(path) as (select path from f where folder = 'src/b11' union select folder || '/index.ts' from ends where folder = 'src/b11' union select dst from walk join fe on path = src),
    dead as (select path from f where path not in (select path from walk) union all select folder || '/index.ts' from ends where folder || '/index.ts' not in (select path from walk))
    select (select count(*) from f) + (select count(*) from ends) + 1 as files, (select count(*) from f where path not in (select path from walk)) as unreferenced,
    (select count(*) from ends where folder || '/index.ts' not in (select path from walk)) + 1 as suspicious,
    (select count(*) from dead where path in (select dst from fe where src <> dst)) as referenced""")
def project_unreferenced_stats(spark, d):
    """All files of the entry point's folder are entry points, so that the main file and the other folders' index files are left over."""
    return analyzers.unreferenced_stats(facts(spark, d), entrypoint="src/b11/index.ts", include_entry_dirs=True)


@_query("""select 'pkg-' || size as name, path, 'import { x } from ' || chr(39) || 'pkg-' || size || chr(39) as raw from f where size > 45""")
def project_implicit_dependencies(spark, d):
    return analyzers.implicit_dependencies(facts(spark, d))


@_query("""select 'pkg-' || size as name, 'implicit' as problem, cast(count(*) as varchar) as detail from f where size > 45 group by 1
    union all select 'pkg-' || n, 'unused', 'package.json' from range(1, 46) t(n) where n not in (select size from f)
    union all select 'left-pad', 'unused', 'package.json' union all select 'old-lib', 'unused', 'package.json'
    union all select 'old-lib', 'outdated', '2.0.0 < 3.0.0'""")
def project_npm_check(spark, d):
    registry = spark.createDataFrame([("old-lib", "3.0.0"), ("left-pad", "1.0.0")], "name string, latest string")
    return analyzers.npm_check(facts(spark, d), registry)


@_query("""select path, unnest(['x', 'y' || k, 'z' || k]) as symbol from f where size in (7, 11)""")
def project_trace(spark, d):
    return analyzers.trace(facts(spark, d), "pkg-7, pkg-11")


@_query("select path, 8 + 2 * h + case when size % 3 = 0 then 3 else 0 end as line, '/parts/list' as api from w where size % 7 = 0")
def project_api_calls(spark, d):
    return analyzers.api_tracer(facts(spark, d), "/parts/list,/other")


@_query("select a.c as src, b.c as dst, list(distinct a.path order by a.path) as files from fe join owner a on a.path = src join owner b on b.path = dst where a.c <> b.c group by 1, 2")
def project_component_edges(spark, d):
    return analyzers.component_edges(facts(spark, d), components(spark, d))


@_query("""select folder[5:] as component, (select count(*) from owner where c = folder[5:]) as files, (select list(distinct dst order by dst) from ce where src = folder[5:]) as components,
    (select list(distinct 'pkg-' || size order by 'pkg-' || size) from f g where g.folder = ends.folder) as packages from ends""")
def project_component_deps(spark, d):
    return analyzers.component_deps(facts(spark, d), components(spark, d)).drop("dependencies")


@_query("""select a.c as src, b.c as dst, list(n.p || y.k || ' named ' || y.path || ' ' || x.path order by n.p || y.k || ' named ' || y.path || ' ' || x.path) as symbols from edges join f x on x.k = src join f y on y.k = dst
    join owner a on a.path = x.path join owner b on b.path = y.path, (values ('v'), ('T')) n(p) where a.c <> b.c group by 1, 2""")
def project_symbol_imports(spark, d):
    return analyzers.symbol_imports(facts(spark, d), components(spark, d)).select("src", "dst", F.array_sort(F.transform("symbols", lambda s: F.concat_ws(" ", s["name"], s["type"], s["from_file"], s["in_file"]))).alias("symbols"))


@_query("""with_refs as (select b.path, n.p || b.k as name, a.path as ref from edges join f a on a.k = src join f b on b.k = dst, (values ('v'), ('T')) n(p) union select folder || '/p' || b || '.ts', 'v' || b, 'src/main.ts' from ends),
        own as (select path, n.p || k as name from f, (values ('v'), ('T')) n(p) union all select path, 'f' || k from f where size % 3 = 0)
    select c as component, own.path, own.name, 'named' as export_type, coalesce(list(distinct ref order by ref) filter (ref is not null), []) as ref_files from own join owner using (path) left join with_refs r on r.path = own.path and r.name = own.name group by 1, 2, 3""".replace("with_refs as", ", with_refs as", 1))
def project_export_calls(spark, d):
    return analyzers.export_calls(facts(spark, d), components(spark, d)).drop("ref_components")


_CHANGED = "changed as (select path, folder, k from f where k in (select dst from edges where src <= 20 and dst <> src) and k % 2 = 0)"


def _changed(spark, d) -> DataFrame:
    """The declaration line of some parts' values."""
    own = facts(spark, d)["symbols"].where("kind = 'variable' and name like 'v%'").select("path", F.substring("name", 2, 20).cast("long").alias("k"), F.col("start_line").alias("line"))
    picked = _part_edges(spark, d).where("src <= 20 and dst % 2 = 0").select(F.col("dst").alias("k")).distinct()
    return own.join(picked, "k").select("path", "line")


@_query(f""", {_CHANGED} select path, 'v' || k as name, 'variable' as kind, true as exported, 'named' as export_type, [3 + h] as lines from changed join w using (path, folder, k)""")
def project_changed_symbols(spark, d):
    return analyzers.changed_symbols(facts(spark, d), _changed(spark, d))


_IMPACT = f""", {_CHANGED}, direct as (select distinct a.path from edges join f a on a.k = src join changed c on c.k = dst where a.path not in (select path from changed)
        union select 'src/main.ts' from changed where k in (select b from ends)),
    walk(path, level) as (select path, 1 from direct union select src, level + 1 from walk join fe on dst = path where level < 3),
    bfs as (select path, min(level) as level from walk where path not in (select path from changed) group by 1)"""


@_query(_IMPACT + " select path, level from bfs")
def project_file_impact(spark, d):
    return impact.file_impact(facts(spark, d), _changed(spark, d), max_depth=3).select("path", "level")


@_query(_IMPACT + " select level, count(*) as n from bfs group by 1")
def project_impact_levels(spark, d):
    return impact.level_histogram(impact.file_impact(facts(spark, d), _changed(spark, d), max_depth=3))


@_query(f""", {_CHANGED}, seeds as (select distinct folder[5:] as c from changed), walk(c, level) as (select c, 0 from seeds union select src, level + 1 from walk join ce on dst = c where level < 2),
    bfs as (select c, min(level) as l from walk group by 1)
    select c as component, 'direct' as kind, 0 as level from seeds union all select src, 'indirect', max(l) + 1 from bfs join ce on dst = c where l < 2 group by 1""")
def project_component_impact(spark, d):
    return impact.component_impact(facts(spark, d), components(spark, d), _changed(spark, d), max_depth=2)


@_query(f""", {_CHANGED}, seeds as (select distinct folder[5:] as c from changed), walk(source, c, level) as (select c, c, 0 from seeds union select source, src, level + 1 from walk join ce on dst = c where level < 4)
    select source, c as component, case when min(level) = 1 then 'depends' else 'indirect' end as relation, min(level) as level from walk where source <> c group by 1, 2""")
def project_mr_impact(spark, d):
    return impact.mr_impact(facts(spark, d), components(spark, d), _changed(spark, d)).drop("way")


@_query(f""", {_CHANGED} select path, 'component' as category, folder[5:] as name from changed union all select 'README.md', 'other', ''""")
def project_classified(spark, d):
    changed = _changed(spark, d).select("path").union(spark.createDataFrame([("README.md",)], "path string"))
    return impact.classify_changed(changed, components(spark, d).select("name", F.lit("component").alias("type"), F.col("root").alias("path")))


@_query("""select path, 'v' || k as name, 'variable' as kind, 3 + h as start_line, 3 + h as end_line, true as exported, 'named' as export_type from w union all select path, 'T' || k, 'interface', 4 + h, 5 + 2 * h, true, 'named' from w
    union all select path, 'y' || k, 'variable', 6 + 2 * h, 6 + 2 * h, false, null from w union all select path, 'z' || k, 'variable', 7 + 2 * h, 7 + 2 * h, false, null from w
    union all select path, 'f' || k, 'function', 8 + 2 * h, 10 + 2 * h, true, 'named' from w where size % 3 = 0
    union all select path, 'text', 'variable', l, l, false, null from (select path, 8 + 2 * h + case when size % 3 = 0 then 3 else 0 end + case when size % 7 = 0 then 1 else 0 end as l from w)""")
def project_symbols(spark, d):
    return facts(spark, d)["symbols"]


@_query("""select a.path, 'T' || a.k as type, 'T' || b.k as reference, ['m' || b.k] as places from edges join f a on a.k = src join f b on b.k = dst""")
def project_type_references(spark, d):
    return facts(spark, d)["type_refs"]


@_query(""", walk(k) as (select a from ends where folder = 'src/b11' union select dst from walk join edges on src = k) select f.path, 'T' || f.k as type from walk join f using (k)""")
def project_type_closure(spark, d):
    first = facts(spark, d)["nodes"].where("kind = 'interface' and path like 'src/b11/%'").agg(F.min_by("name", F.substring("name", 2, 20).cast("long")).alias("type"))
    return bundle.closure(facts(spark, d), first.select(F.lit("src/b11/index.ts").alias("path"), "type"))


@_query(""", walk(entry, k) as (select folder || '/index.ts:T' || a, a from ends where folder in ('src/b11', 'src/b12', 'src/b13') union select entry, dst from walk join edges on src = k)
    select entry, f.path, 'T' || f.k as type from walk join f using (k)""")
def project_type_closures(spark, d):
    """The types that each of three entries needs, by entry."""
    first = facts(spark, d)["nodes"].where("kind = 'interface'").select(F.regexp_extract("path", "^src/b1[123]/", 0).alias("folder"), F.col("name").alias("type"), F.substring("name", 2, 20).cast("long").alias("k")).where("folder <> ''")
    entries = first.groupBy("folder").agg(F.min_by("type", "k").alias("type")).select(F.concat("folder", F.lit("index.ts")).alias("path"), "type")
    return bundle.closures(facts(spark, d), entries)


@_query("""select f.path, 'f' || k as name, [{'name': 'x', 'type': 'any'}] as parameters from f where size % 3 = 0""")
def project_functions(spark, d):
    own = facts(spark, d)["functions"]
    return own.select("path", "name", F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"))).alias("parameters"))


@_query("""select f.path, 'return v' || k || ' as number' as raw from f where size % 3 = 0""")
def project_returns(spark, d):
    return facts(spark, d)["returns"].select("path", "raw")


@_query("""select f.path, 'f' || k as name, 'x' as inner_name from f where size % 3 = 0""")
def project_ancestors(spark, d):
    nodes = facts(spark, d)["nodes"]
    up = navigation.first_ancestor(nodes, "function").withColumnRenamed("ancestor", "up")
    named = nodes.where("kind = 'parameter'").select("path", "id", F.col("name").alias("inner_name")).join(up, ["path", "id"])
    return named.join(nodes.select("path", F.col("id").alias("up"), "name"), ["path", "up"]).select("path", "name", "inner_name")


@_query("""select path, kind, name, 'f' || k as around, cast(1 as integer) as distance from f, (values ('parameter', 'x'), ('any', ''), ('as', ''), ('return', '')) n(kind, name) where size % 3 = 0
    union all select a.path, n.kind, n.p || b.k, 'T' || a.k, 1 from edges join f a on a.k = src join f b on b.k = dst, (values ('member', 'm'), ('reference', 'T')) n(kind, p)""")
def project_enclosing(spark, d):
    """All declarations around each node, with their distance."""
    nodes = facts(spark, d)["nodes"]
    pairs = navigation.ancestors(nodes).join(nodes.select("path", "id", "kind", "name"), ["path", "id"])
    return pairs.join(nodes.select("path", F.col("id").alias("ancestor"), F.col("name").alias("around")), ["path", "ancestor"]).select("path", "kind", "name", "around", "distance")


@_query("""select path, 'variable' as kind, 'v' || k as name from f union all select path, 'return', '' from f where size % 3 = 0 union all select path, 'parameter', 'x' from f where size % 3 = 0
    union all select path, 'any', '' from f where size % 3 = 0 union all select path, 'as', '' from f where size % 3 = 0""")
def project_node_at(spark, d):
    """The innermost node at the places where some texts stand."""
    marks = {"export const v": 7, "  return v": 2, "(x: any)": 1, ": any) {": 2, " as number": 1}
    content = facts(spark, d)["code"].where("path like 'src/b%/p%'")
    found = F.array(*[F.instr("content", m) + (n - 1) - F.when(F.instr("content", m) == 0, 1 << 20).otherwise(0) for m, n in marks.items()])
    points = content.select("path", F.explode(found).alias("offset")).where("offset >= 0")
    return navigation.node_at(facts(spark, d)["nodes"], points).select("path", "kind", "name")


@_query("""select x.path, 'v' || x.k as name, 1 + (x.size % 3 = 0)::int + (select count(*) from edges where dst = x.k) + (select count(*) from ends where b = x.k) as "references",
        1 + (select count(*) from edges where dst = x.k) + (select count(*) from ends where b = x.k) as files from f x
    union all select x.path, 'T' || x.k, 1 + 2 * (select count(*) from edges where dst = x.k), 1 + (select count(*) from edges where dst = x.k) from f x
    union all select path, 'y' || k, 2, 1 from f union all select path, 'z' || k, 1, 1 from f union all select path, 'f' || k, 1, 1 from f where size % 3 = 0 union all select path, 'text', 1, 1 from f""")
def project_references(spark, d):
    """Uses of each declaration by scope; the parameter x of a function is not the imported x."""
    return binding.reference_counts(facts(spark, d)).select("path", "name", "references", "files")


@_query("""select b.path as def_path, 'v' || b.k as name, count(*) as files from edges join f b on b.k = dst group by 1, 2""")
def project_definitions(spark, d):
    own = navigation.definitions(facts(spark, d)).where("name like 'v%' and path <> def_path")
    return own.groupBy("def_path", "name").agg(F.count("*").alias("files"))


@_query("""select 'src/main.ts' as path, 'l' || folder[6:] as name, folder || '/p' || b || '.ts' as def_path, 'v' || b as def_name from ends""")
def project_goto_definition(spark, d):
    points = facts(spark, d)["imports"].where("path = 'src/main.ts' and identifier <> ''").select("path", F.col("identifier").alias("name"))
    return navigation.goto_definition(facts(spark, d), points).select("path", "name", "def_path", "def_name")


@_query("""select b.path as src_path, n.p || b.k as name, min(a.path) as path from edges join f a on a.k = src join f b on b.k = dst, (values ('v'), ('T')) n(p) group by 1, 2
    union all select folder || '/index.ts', 'last', 'src/main.ts' from ends""")
def project_first_importers(spark, d):
    return analyzers.first_importers(facts(spark, d)).where("name <> ''")


@_query("select path, k, json_extract_string(j, '$.size') as size from (select path, k, json_object('size', size) as j from f)")
def project_json_values(spark, d):
    part = table(spark, d, "part").select(F.expr(f"concat({_folder('p_brand')}, '/p', p_partkey, '.ts')").alias("path"), F.col("p_partkey").alias("k"), F.to_json(F.struct(F.col("p_size").alias("size"))).alias("value"))
    return results.json_values(part, "$.size").select("path", "k", F.col("found").alias("size"))


@_query("""select k, '{"size":' || size || ',"inner":{"folder":"' || folder || '"}}' as value from f""")
def project_stripped_fields(spark, d):
    size, folder = F.col("p_size").alias("size"), F.expr(_folder("p_brand"))
    nested = F.struct(size, F.col("p_name").alias("raw"), F.struct(folder.alias("folder"), F.col("p_type").alias("raw"), size.alias("hidden")).alias("inner"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), nested.alias("s"))
    return results.without_fields(part, ["raw", "s.inner.hidden"]).select("k", F.to_json("s").alias("value"))


@_query(f""", walk(path, level) as (select 'src/b11/p' || a || '.ts', 0 from ends where folder = 'src/b11' union select src, level + 1 from walk join fe on dst = path where level < 100)
    select path, min(level) as level from walk where path <> (select 'src/b11/p' || a || '.ts' from ends where folder = 'src/b11') group by 1""")
def project_find_callers(spark, d):
    first = facts(spark, d)["files"].where("path like 'src/b11/p%'").agg(F.min_by("path", F.regexp_extract("path", r"p(\d+)\.ts", 1).cast("long"))).first()[0]
    return impact.find_callers(facts(spark, d), first)


@_query("""select src as node, count(*) as fan_out, (select count(*) from fe g where g.dst = fe.src) as fan_in from fe group by 1""")
def project_fan_in_out(spark, d):
    edges = durable(analyzers.file_edges(facts(spark, d)), "edges")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    in_ = graph.reverse_edges(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_in"))
    return out.join(in_, "node", "left").select("node", "fan_out", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
