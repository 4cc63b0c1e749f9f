"""Globs as data, folders at any depth, export precedence, rewriting at once, and resolution with and without a base folder."""

from pyspark.sql import functions as F

from factloom.functions.scalars import glob_regex
from factloom.operators import analyzers, bundle, impact, relational, results
from factloom.sources import code_facts, tsconfig


def project(spark, files, aliases=()):
    rows = [(p, c, len(c)) for p, c in files.items()]
    return analyzers.facts_of(spark.createDataFrame(rows, "path string, content string, size_bytes long"), spark.createDataFrame(list(aliases), "alias string, target string"))


def test_owning_configuration(spark):
    files = {
        "tsconfig.json": '{"include": ["src", "lib/**/*.ts", "top.ts"], "exclude": ["src/gen", "**/*.skip.ts"], "files": ["src/gen/kept.ts"]}', "tsconfig.test.json": '{"include": ["**/*.test.ts"]}',
        "packages/a/tsconfig.json": "{}", "packages/b/jsconfig.json": '{"include": ["./x/?.js", "../shared/*"]}',
    }
    configs = tsconfig.merged(tsconfig.configs(spark.createDataFrame(list(files.items()), "path string, content string")))
    paths = {
        "src/a.ts": "tsconfig.json", "src/deep/b.tsx": "tsconfig.json", "src/gen/c.ts": None, "src/gen/kept.ts": "tsconfig.json", "src/d.skip.ts": None, "src/e.test.ts": "tsconfig.json", "other/f.test.ts": "tsconfig.test.json",
        "lib/x/y.ts": "tsconfig.json", "lib/z.js": None, "top.ts": "tsconfig.json", "topXts": None, "packages/a/m.ts": "packages/a/tsconfig.json", "packages/a/n.test.ts": "packages/a/tsconfig.json",
        "packages/a/node_modules/p/q.ts": None, "packages/b/x/1.js": "packages/b/jsconfig.json", "packages/b/x/12.js": None, "packages/shared/s.js": "packages/b/jsconfig.json", "packages/shared/t/u.js": None, "srcs/v.ts": None,
    }
    got = {r.path: r.config for r in tsconfig.owned(spark.createDataFrame([(p,) for p in paths], "path string"), configs).collect()}
    assert got == {p: c for p, c in paths.items() if c}


def test_glob_column_equals_glob_regex(spark):
    given = ["src/**/*.ts", "a.b/*", "**/x", "**", "a?c/**", "[id]/(x)/*.ts", "a+b/$c/*.{ts}", "**/*"]
    rows = spark.createDataFrame([(g,) for g in given], "g string").select("g", tsconfig.glob_column(F.col("g")).alias("r")).collect()
    paths = ["src/a.ts", "src/b/c.ts", "a.b/c", "aXb/c", "x", "y/x", "abc/d", "a/c/d", "[id]/(x)/1.ts", "a+b/$c/d.{ts}", "a/b/c"]
    import re

    for r in rows:
        own = glob_regex(r.g) if "{" not in r.g else r.r
        assert [bool(re.search(r.r, p)) for p in paths] == [bool(re.search(own, p)) for p in paths], r.g


def test_leading_configuration_of_a_folder(spark):
    files = {"tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "tsconfig.test.json": '{"compilerOptions": {"paths": {"@/*": ["test/*"], "~/*": ["x/*"]}}}', "b/jsconfig.json": '{"compilerOptions": {"baseUrl": "."}}', "b/tsconfig.z.json": "{}"}
    merged = tsconfig.merged(tsconfig.configs(spark.createDataFrame(list(files.items()), "path string, content string")))
    assert {(r.config_dir, r.alias, r.target) for r in tsconfig.aliases(merged).collect()} == {("", "@", "src"), ("b", "", "b")}


def test_bare_specifiers_need_a_base_folder(spark):
    files = {"config/index.ts": "export default 1", "src/m.ts": "import c from 'config'; import d from 'config/x'\nimport type X = Foo\nconst s = `\nimport e from 'f'\n`\nimport{g}from './g'", "src/g.ts": "export const g = 1"}
    rows = {(r.specifier, r.src_path, r.npm_pkg) for r in project(spark, files)["imports"].collect()}
    assert rows == {("config", None, "config"), ("config/x", None, "config"), ("./g", "src/g.ts", None)}
    rows = {(r.specifier, r.src_path, r.npm_pkg) for r in project(spark, files, [("", "")])["imports"].collect()}
    assert rows == {("config", "config/index.ts", None), ("config/x", None, "config"), ("./g", "src/g.ts", None)}


def test_folders_at_any_depth(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/b/c/d.ts", "x/b/c/d.ts", "b/d.ts", "bc/d.ts", "d.ts", "x/y/a/b/z/b/c/e.ts")], "path string")
    folders = spark.createDataFrame([("b",), ("b/c",), ("a/b",)], "folder string")
    got = {r.path: r.folder for r in relational.folder_at_any_depth(paths, "path", folders, "folder").collect()}
    assert got == {"a/b/c/d.ts": "a/b", "x/b/c/d.ts": "b/c", "b/d.ts": "b", "x/y/a/b/z/b/c/e.ts": "a/b"}
    components = spark.createDataFrame([("Button", "Button"), ("Deep", "ui/Button")], "name string, root string")
    files = spark.createDataFrame([("packages/x/Button/a.ts",), ("src/ui/Button/b.ts",), ("src/Buttons/c.ts",)], "path string")
    assert {r.path: r.component for r in analyzers.component_of(files, components).collect()} == {"packages/x/Button/a.ts": "Button", "src/ui/Button/b.ts": "Deep"}


def test_changed_files_are_classified_without_a_nested_loop(spark):
    manifest = spark.createDataFrame([("B", "component", "src/b"), ("f", "functions", "src/b/f.ts"), ("deep", "component", "src/b/deep")], "name string, type string, path string")
    changed = spark.createDataFrame([("src/b/f.ts",), ("src/b/deep/x.ts",), ("src/bb/x.ts",)], "path string")
    out = impact.classify_changed(changed, manifest)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {("src/b/f.ts", "component", "B"), ("src/b/deep/x.ts", "component", "deep"), ("src/bb/x.ts", "other", "")}


def test_export_precedence(spark):
    files = {
        "a.ts": "export const x = 1\nexport const y = 1\nexport const w = 1", "b.ts": "export const y = 2\nexport const z = 2\nexport const w = 2", "index.ts": "export * from './a'\nexport * from './b'\nexport const x = 3\nexport { w } from './b'",
        "outer.ts": "export * from './index'\nexport { y as why } from './index'", "m.ts": "import { x, y, z, w } from './outer'", "c1.ts": "export * from './c2'\nexport const p = 1", "c2.ts": "export * from './c1'\nexport const q = 1",
        "d.ts": "export * from './a'\nexport * from './e'", "e.ts": "export * from './a'",
    }
    facts = project(spark, files)
    got = {(r.path, r.name): (r.origin_path, r.origin_name) for r in facts["origins"].collect()}
    assert got[("index.ts", "x")] == ("index.ts", "x") and got[("outer.ts", "x")] == ("index.ts", "x") and got[("outer.ts", "z")] == ("b.ts", "z")
    assert got[("index.ts", "w")] == got[("outer.ts", "w")] == ("b.ts", "w")
    # Ambiguous: two stars bring y; nothing that is built on it exists.
    assert not {("index.ts", "y"), ("outer.ts", "y"), ("outer.ts", "why")} & got.keys()
    assert got[("c1.ts", "q")] == ("c2.ts", "q") and got[("c2.ts", "p")] == ("c1.ts", "p") and got[("d.ts", "y")] == ("a.ts", "y")
    unused = {(r.path, r.name) for r in analyzers.unconsumed_exports(facts).where("path in ('a.ts', 'b.ts', 'index.ts')").collect()}
    assert unused == {("a.ts", "x"), ("a.ts", "y"), ("a.ts", "w"), ("b.ts", "y")}


def test_names_are_rewritten_at_once(spark):
    text = "export interface B { A: A; b?: B.C; s: 'A'; n: ns.A; m: Map<A, B>; /* A */ t: X extends A ? B : A }"
    rules = {"A": "B", "B": "B_f2", "ns.A": "Far"}
    out = spark.createDataFrame([(text, rules)], "t string, r map<string,string>").select(bundle.renamed_text(F.col("t"), F.col("r"))).first()[0]
    assert out == "export interface B_f2 { A: B; b?: B_f2.C; s: 'A'; n: Far; m: Map<B, B_f2>; /* A */ t: X extends B ? B_f2 : B }"
    files = {"f1.ts": "export interface B { n: number }", "f2.ts": "import { B as A } from './f1'\nexport interface B { x: A; own: B }"}
    rows = {(r.path, r.final_name): r.text for r in bundle.bundle(project(spark, files), spark.createDataFrame([("f2.ts", "B")], "path string, type string")).collect()}
    assert rows == {("f1.ts", "B"): "export interface B { n: number }", ("f2.ts", "B_f2"): "export interface B_f2 { x: B; own: B_f2 }"}


def test_json_paths_may_hold_quotes(spark):
    rows = spark.createDataFrame([('{"a b": {"c": 1}, "it\'s": [2]}',)], "value string")
    assert results.json_values(rows, "$['a b'].c").first().found == "1" and results.json_values(rows, '$["it\'s"][0]').first().found == "2"
    assert [r.found for r in results.json_elements(rows, '$["it\'s"]').collect()] == ["2"]


def test_candidates_come_in_order(spark):
    wanted = spark.createDataFrame([("a/m.ts", "@/x"), ("a/m.ts", "./x")], "path string, specifier string")
    tried = code_facts.candidates(wanted, spark.createDataFrame([("@", "src"), ("", "base")], "alias string, target string"))
    first = {(r.specifier, r.rank): r.src_path for r in tried.where("nth = 1").collect()}
    assert first == {("./x", 0): "a/x.ts", ("@/x", -1): "src/x.ts", ("@/x", 1): "base/@/x.ts"}


def test_specifiers_meet_stems_as_they_meet_candidates(spark):
    paths = ["src/a.ts", "src/a.d.ts", "src/a/index.tsx", "src/b/index.js", "lib/a.tsx", "lib/c.jsx", "src/d", "src/d.ts", "index.ts", "src/e.d.ts", "base/g.ts"]
    wanted = [("src/x.ts", s) for s in ("./a", "./a.d", "./a/", "./b", "./d", "./e", "..", "@/a", "@/c", "@/none", "g", "pkg", "../lib/./a")]
    files, facts = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(wanted, "path string, specifier string")
    aliases = spark.createDataFrame([("@", "src"), ("@", "lib"), ("", "base")], "alias string, target string")
    slow = {(r.path, r.specifier): r.src_path for r in code_facts.first_existing(code_facts.candidates(facts, aliases), files).collect()}
    fast = {(r.path, r.specifier): r.src_path for r in code_facts.resolve(facts, files, aliases).collect() if r.src_path}
    assert fast == slow and slow["src/x.ts", "@/a"] == "src/a.ts" and slow["src/x.ts", "g"] == "base/g.ts"


def test_source_texts_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(code_facts, "PART_LETTERS", 1000)
    rows = [(f"src/f{i}.ts", f"export const v{i}: any = {i}\n" * 4) for i in range(100)]
    parts = code_facts.dealt(spark.createDataFrame([*rows, ("a.css", "a {}")], "path string, content string").coalesce(1)).withColumn("part", F.input_file_name())
    assert parts.count() == 100 and 5 <= parts.select("part").distinct().count() <= 13
    facts = analyzers.facts_of(spark.createDataFrame(rows, "path string, content string").coalesce(1), spark.createDataFrame([], "alias string, target string"))
    assert facts["code"].rdd.getNumPartitions() > 1 and facts["any"].count() == 400


def test_tags_add_no_edges_to_those_of_imports(spark):
    rows = [("a.tsx", "import Box, { Row as R } from './b'\nimport * as ui from './c'\nconst x = <Box><R /><ui.Cell /><Own /></Box>\n"), ("b.tsx", "export default 1\n"), ("c.tsx", "export const Cell = 1\n"), ("d.tsx", "")]
    facts = analyzers.facts_of(spark.createDataFrame(rows, "path string, content string"), spark.createDataFrame([], "alias string, target string"))
    tags = {(r.path, r.src_path) for r in facts["jsx"].where("src_type = 'file'").collect()}
    assert tags == {("a.tsx", "b.tsx"), ("a.tsx", "c.tsx")} == {tuple(r) for r in analyzers.file_edges(facts).collect()}
