"""Nodes, configurations, diffs, bundles, navigation and results on small inputs of our own."""

from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import analyzers, bundle, impact, navigation, reports, results
from factloom.sources import code_facts, diff, manifest, outline, tsconfig
from factloom.sources.versions import Versions

SOURCE = """import a, { b as c } from './x' // a comment: any
export const enum Color { Red, Blue }
export const { a1, b1: { z }, ...rest } = source
export const p = 1, q: any = other
/* as any */
export interface Props extends Base<Omit<Q, 'x'>> {
  user: User[]; onClick?: (e: MouseEvent) => void
}
export type U = Props | Other["x"]
export default function decl(p: number, { x, y }: Opts, ...r: string[]) {
  return foo(bar('as any'), y as Foo)
}
const Panel = (props: P) => <Box size={3} {...props}><b>hi</b></Box>
class K { method(a) { return this.fetch('/api', 1) } }
function outer() { function inner() { return 1 } }
"""


def found(kind, *keys):
    return [tuple(n["more"].get(k, n.get(k)) for k in keys) for n in outline.nodes(SOURCE) if n["kind"] == kind]


def test_declarations():
    assert found("enum", "name", "exported") == [("Color", True)]
    assert [n for n, e in found("variable", "name", "exported") if e] == ["a1", "z", "rest", "p", "q"]
    assert ("decl", "true", 10, 12) in found("function", "name", "default", "start_line", "end_line") and {"outer", "inner"} <= {n for n, in found("function", "name")}


def test_calls_parameters_and_tags():
    assert found("call", "name", "argument") == [("foo", "bar('as any')"), ("bar", "'as any'"), ("this.fetch", "'/api'")]
    assert found("parameter", "name", "type", "rest") == [("p", "number", "false"), ("{ x, y }", "Opts", "false"), ("r", "string[]", "true"), ("props", "P", "false")]
    assert found("jsx", "name", "attributes", "spread") == [("Box", "size", "props"), ("b", "", "")]


def test_keywords_outside_of_comments_and_strings_only():
    assert found("any", "start_line") == [(4,)] and found("as", "start_line") == [(11,)] and len(found("return", "start_line")) == 3
    node = next(n for n in outline.nodes("const a = b as string;") if n["kind"] == "as")
    assert (node["start_line"], node["start_column"], node["text"]) == (1, 10, "const a = b as string;")


def test_type_references_and_members():
    assert {r for r, in found("reference", "name")} == {"Base", "Q", "User", "MouseEvent", "Props", "Other"}
    assert found("member", "name", "type") == [("user", "User[]"), ("onClick", "(e: MouseEvent) => void")]


def test_odd_sources_do_not_crash():
    for text in ("", "}", "function", "export", "const {", "interface A {", "type =", "`${", "/*", "a(" * 50, "<A", "export default", "class", "x = <T>(y: T) => y"):
        outline.nodes(text)


def test_configurations(spark):
    rows = [
        ("tsconfig.json", '{ // top\n "extends": "./base", "compilerOptions": {"paths": {"@/*": ["src/*", "other/*"],}, } }'),
        ("base.json", "{}"), ("tsconfig.base.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["lib/*"], "@/*": ["old/*"]}}}'),
        ("packages/a/tsconfig.json", '{"extends": "../../tsconfig.base.json", "compilerOptions": {"paths": {"#/*": ["packages/a/x/*"]}}}'), ("src/f.ts", ""),
    ]
    configs = tsconfig.configs(spark.createDataFrame(rows, "path string, content string"))
    merged = tsconfig.merged(configs)
    got = {(r.config_dir, r.alias): r.target for r in tsconfig.aliases(merged).collect()}
    assert got[("", "@")] in ("src", "old") and got[("packages/a", "#")] == "packages/a/x" and got[("packages/a", "~")] == "lib" and got[("packages/a", "")] == ""
    paths = spark.createDataFrame([("packages/a/z.ts",), ("packages/b/z.ts",)], "path string")
    assert {(r.path, r.config_dir) for r in tsconfig.nearest(paths, spark.createDataFrame([("",), ("packages/a",)], "config_dir string")).collect()} == {("packages/a/z.ts", "packages/a"), ("packages/b/z.ts", "")}
    hit = paths.where(tsconfig.matches(F.col("path"), ["packages", "!packages/b/**"])).collect()
    assert [r.path for r in hit] == ["packages/a/z.ts"]


def test_resolution_by_nearest_configuration(spark):
    files = spark.createDataFrame([("a/src/u.ts",), ("b/src/u.ts",), ("a/m.ts",), ("b/m.ts",), ("a/src/w/index.tsx",)], "path string")
    aliases = spark.createDataFrame([("a", "@", "a/src"), ("b", "@", "b/src"), ("a", "", "a")], "config_dir string, alias string, target string")
    facts = spark.createDataFrame([("a/m.ts", "@/u"), ("b/m.ts", "@/u"), ("a/m.ts", "src/w"), ("a/m.ts", "@scope/pkg/x"), ("b/m.ts", "./none")], "path string, specifier string")
    got = {(r.path, r.specifier): (r.src_path, r.npm_pkg) for r in code_facts.resolve(facts, files, aliases).collect()}
    assert got == {("a/m.ts", "@/u"): ("a/src/u.ts", None), ("b/m.ts", "@/u"): ("b/src/u.ts", None), ("a/m.ts", "src/w"): ("a/src/w/index.tsx", None), ("a/m.ts", "@scope/pkg/x"): (None, "@scope/pkg"), ("b/m.ts", "./none"): (None, None)}


def test_scan_leaves_folders_out(spark, tmp_path):
    for name in ("src/a.ts", "node_modules/x/b.ts", "src/__test__/c.ts", "src/d.test.tsx", "e.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * 2000)
    got = {(r.path, r.file_type, r.size_text) for r in code_facts.scan(spark, str(tmp_path)).collect()}
    assert got == {("src/a.ts", "ts", "1.95 KB"), ("e.json", "json", "1.95 KB")}


def test_diff_forms(spark):
    text = "diff --git a/old/é.ts b/new/é.ts\r\n@@ -1,2 +5,3 @@ f\r\n one\r\n+two\r\n-gone\r\n+three\r\n@@ -9 +20 @@\r\n+last\r\n"
    d = spark.createDataFrame([(text,), (text,), ("",), (None,), ("no diff at all",)], "text string")
    assert {tuple(r) for r in diff.changed_lines(d).collect()} == {("new/é.ts", 6), ("new/é.ts", 7), ("new/é.ts", 20)}
    assert {r.path for r in diff.changed_files(d).collect()} == {"old/é.ts"}
    api = spark.createDataFrame([("x.ts", "@@ -0,0 +1,2 @@\n+a\n+b"), ("y.ts", None)], "new_path string, diff string")
    assert {tuple(r) for r in diff.changed_lines_of_api(api).collect()} == {("x.ts", 1), ("x.ts", 2)}
    assert diff.diff_texts(spark, "auto", text).count() == 1 and diff.under_root(api.select(F.col("new_path").alias("path")), "/r").first().path == "/r/x.ts"


FILES = {
    "src/types/user.ts": "export interface User { id: Id; role: Role }\nexport type Id = string\nexport enum Role { A }\n",
    "src/types/index.ts": "export * from './user'\nexport { Item as Thing } from './item'\n",
    "src/types/item.ts": "import type { User } from './user'\nexport interface Item { owner: User; world: World }\n",
    "src/types/world.d.ts": "interface World { name: string; inner: Inner }\ninterface Inner { n: number }\n",
    "src/types/other.ts": "import * as ns from './index'\nexport interface User { real: ns.User; t: ns.Thing }\n",
    "src/main.ts": "import { Thing } from './types'\nimport def from './def'\nexport const t: Thing = def()\n",
    "src/def.ts": "const local = () => 1\nexport default local\n",
    "src/again.ts": "import { t } from './main'\nexport { t as renamed }\n",
    "src/last.ts": "import { renamed } from './again'\nrenamed\n",
}


def project(spark):
    rows = [(p, c, len(c)) for p, c in FILES.items()]
    return analyzers.facts_of(spark.createDataFrame(rows, "path string, content string, size_bytes long"), spark.createDataFrame([], "alias string, target string"))


def test_type_bundle(spark):
    facts = project(spark)
    entries = bundle.entries_of(spark.createDataFrame([("src/types/index.ts:Thing:Mine",), ("src/types/other.ts:User",)], "entry string"))
    assert {r.alias for r in entries.collect()} == {"Mine", "User"}
    rows = {(r.path, r.type): (r.final_name, r.text) for r in bundle.bundle(facts, entries).collect()}
    assert {k[1] for k in rows} == {"Item", "User", "Id", "Role", "World", "Inner"} and len(rows) == 7
    assert {v[0] for k, v in rows.items() if k[1] == "User"} == {"User", "User_user"}
    other = rows[("src/types/other.ts", "User")]
    assert other[0] == "User" and "real: User_user" in other[1] and "t: Item" in other[1] and "owner: User_user" in rows[("src/types/item.ts", "Item")][1]


def test_navigation(spark):
    facts = project(spark)
    nodes = facts["nodes"]
    at = navigation.node_at(nodes, spark.createDataFrame([("src/types/user.ts", 30)], "path string, offset int")).first()
    assert at.kind in ("member", "reference", "interface")
    assert navigation.symbol_at(nodes, spark.createDataFrame([("src/def.ts", 1)], "path string, line int")).first().name == "local"
    where = navigation.goto_definition(facts, spark.createDataFrame([("src/main.ts", "def"), ("src/last.ts", "renamed")], "path string, name string"))
    assert {(r.def_path, r.def_name) for r in where.collect()} == {("src/def.ts", "local"), ("src/main.ts", "t")}
    assert {(r.path, r.name) for r in navigation.find_references(facts, "src/main.ts", "t").collect()} == {("src/main.ts", "t"), ("src/again.ts", "t"), ("src/again.ts", "renamed"), ("src/last.ts", "renamed")}
    info = navigation.quick_info(facts, spark.createDataFrame([("src/types/item.ts", "Item")], "path string, name string")).first()
    assert (info.kind, info.declared) == ("interface", "export interface Item")
    assert navigation.children(nodes).count() > 0 and navigation.with_category(nodes).where("category = 'type'").count() > 0
    assert navigation.enclosing_chain(nodes).where("level = 0").count() == nodes.where("parent = -1").count()


def test_impact_ways_and_counts(spark):
    facts = project(spark)
    changed = spark.createDataFrame([("src/main.ts", 3)], "path string, line int")
    assert {(r.path, r.level, r.symbols) for r in impact.file_impact(facts, changed).collect()} == {("src/again.ts", 1, 1), ("src/last.ts", 1, 1)}
    assert {r.way for r in impact.file_impact_paths(facts, changed).collect()} == {"src/again.ts", "src/last.ts"}
    rows = spark.createDataFrame([("a", 1, "low"), ("b", 2, "critical"), ("c", 2, "low")], "name string, level int, risk string")
    assert [r.name for r in impact.by_level_and_name(rows, "name").collect()] == ["b", "c", "a"] and [r.name for r in impact.by_risk(rows, "risk", "name").collect()] == ["b", "a", "c"]


def test_reports(spark):
    facts = project(spark)
    changed = spark.createDataFrame([("src/main.ts", 3), ("README.md", 1)], "path string, line int")
    report = reports.impact_report(facts, changed)
    assert {tuple(r) for r in report.collect()} == {("changed", "src/main.ts", 0, 1, None), ("changed", "README.md", 0, 0, None), ("impact", "src/again.ts", 1, 1, "src/again.ts"), ("impact", "src/last.ts", 1, 1, "src/last.ts")}
    assert reports.impact_totals(facts, report).first().asDict() == {"files": 9, "changed_files": 2, "impact_files": 2}
    classified = spark.createDataFrame([("b/x.ts", "component", "B"), ("f/y.ts", "functions", "f"), ("b/a.ts", "component", "B"), ("z.md", "other", "")], "path string, category string, name string")
    impacts = spark.createDataFrame([("B", "C", "depends", 1, None), ("B", "D", "indirect", 2, "B → C → D")], "source string, component string, relation string, level int, way string")
    assert [r.line for r in reports.in_order(reports.mr_report(classified, impacts)).collect()] == [
        "• B", "  - changed itself", "• C", "  - depends on B", "• D", "  - through B → C → D", "• B", "  - b/a.ts", "  - b/x.ts", "• f", "  - f/y.ts", "- z.md", "3 components affected, 1 of them changed directly",
    ]
    assert [r.line for r in reports.in_order(reports.mr_report(classified.limit(0), impacts.limit(0))).collect()] == ["0 components affected, 0 of them changed directly"]


def test_results_and_fields(spark, tmp_path):
    facts = project(spark)
    result = results.run("unconsumed", facts)
    assert result.summary()["files"] == 8 and result.to_json().count() == result.df.count()
    results.all_as_json([result]).collect()
    df = spark.createDataFrame([(1, [{"raw": "x", "k": "y"}], {"raw": "m", "o": "n"})], "id int, list array<struct<raw:string,k:string>>, m map<string,string>")
    row = results.without_fields(df, ["raw"]).first()
    assert row.list[0].asDict() == {"k": "y"} and row.m == {"o": "n"}
    assert results.without_fields(df, ["list.k"]).first().list[0].asDict() == {"raw": "x"}
    results.store_database(facts, str(tmp_path / "db"))
    assert Versions(spark, str(tmp_path / "db")).table("imports").where("id is null").count() == 0
    texts = spark.createDataFrame([('{"a": {"b": [1, 2]}}',), ("broken",)], "value string")
    assert [r.found for r in results.json_values(texts, "$.a.b[1]").collect()] == ["2", None]
    assert {r.found for r in results.json_elements(texts, "$.a.b").collect()} == {"1", "2"}


def test_manifest(spark):
    text = '{"components": {"Button": {"type": "component", "path": "./src/Button/"}}, "functions": {"f": {"path": "src/f"}, "g": {"path": ""}, "h": {"type": "component", "path": "src/h"}}}'
    rows = manifest.manifest(spark.createDataFrame([(text,)], "content string"))
    assert {(r.name, r.type, r.path) for r in rows.collect()} == {("Button", "component", "src/Button"), ("f", "functions", "src/f"), ("g", "functions", ""), ("h", "component", "src/h")}
    assert {(r.name, r.problem) for r in manifest.problems(rows).collect()} == {("g", "no path"), ("h", "wrong type")} and manifest.components(rows).first().root == "src/Button"


def test_scalars(spark):
    df = spark.createDataFrame([("export default connect(App)",), ("export default class extends B {}",), ("export default function f() {}",)], "t string")
    assert [r[0] for r in df.select(scalars.default_export_name(F.col("t"))).collect()] == ["connect", "default", "f"]
    assert df.select(F.length(scalars.short_hash(F.col("t")))).first()[0] == 6
    one = spark.createDataFrame([("a/b/c.ts", "b")], "p string, f string")
    assert one.select(scalars.has_segment(F.col("p"), F.col("f")), scalars.in_folder(F.col("p"), F.lit("a/b")), scalars.in_folder(F.col("p"), F.lit("a/bc"))).first() == (True, True, False)
