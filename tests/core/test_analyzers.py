"""Analyzers on a small project of our own."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import analyzers
from factloom.sources.diff import changed_lines

FILES = {
    "package.json": '{"dependencies": {"react": "18.0.0", "left-pad": "1.0.0"}, "devDependencies": {"typescript": "5.0.0"}}',
    "src/main.tsx": "import { Panel } from './panel'\nimport * as math from '@/math'\nconst x: any = math.twice(2)\n",
    "src/panel/index.ts": "export { Panel } from './Panel'\n",
    "src/panel/Panel.tsx": "import React from 'react'\nimport axios from 'axios'\nimport { twice } from '@/math'\nconst R = React\nexport const Panel = () => <Box />\nexport function spare() {\n  return 1 as number\n}\n",
    "src/math.ts": "export function twice(n: number) {\n  return n * 2\n}\n",
    "src/alone.ts": "export const unused = 1\n",
    "src/math.test.ts": "import { twice } from './math'\n",
    "styles/a.scss": "a {}", "README.md": "# x",
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([(p, len(c), c) for p, c in FILES.items()], "path string, size_bytes long, content string")
    return analyzers.facts_of(files, spark.createDataFrame([("@", "src")], "alias string, target string"))


@pytest.fixture(scope="module")
def components(spark):
    return spark.createDataFrame([("panel", "src/panel"), ("app", "src")], "name string, root string")


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_imports_resolve_to_files_and_packages(facts):
    got = as_set(facts["imports"], "path", "specifier", "src_path", "npm_pkg")
    assert ("src/main.tsx", "@/math", "src/math.ts", None) in got
    assert ("src/main.tsx", "./panel", "src/panel/index.ts", None) in got
    assert ("src/panel/Panel.tsx", "react", None, "react") in got


def test_counts(facts):
    assert as_set(analyzers.count_any(facts), "path", "findings") == {("src/main.tsx", 1)}
    assert as_set(analyzers.count_as(facts), "path", "findings") == {("src/panel/Panel.tsx", 1)}


def test_unconsumed_follows_re_exports(facts):
    assert as_set(analyzers.unconsumed_exports(facts), "path", "name") == {("src/panel/Panel.tsx", "spare"), ("src/alone.ts", "unused")}


def test_unreferenced(facts):
    assert as_set(analyzers.unreferenced_files(facts, "src/main.tsx"), "path", "verdict") == {("src/alone.ts", "unreferenced"), ("src/math.test.ts", "ignored")}


def test_entry_points_and_files_that_only_dead_files_take(spark):
    files = {"src/index.ts": "import './used'", "src/used.ts": "", "src/dead.ts": "import './kept'", "src/kept.ts": "", "src/lib/reindex.ts": "", "App.tsx": "", "src/self.ts": "import './self'"}
    facts = analyzers.facts_of(spark.createDataFrame([(p, len(c), c) for p, c in files.items()], "path string, size_bytes long, content string"), spark.createDataFrame([], "alias string, target string"))
    paths = lambda df: {r.path for r in df.collect()}
    assert paths(analyzers.unreferenced_files(facts)) == {"src/dead.ts", "App.tsx"}
    assert paths(analyzers.unreferenced_files(facts, "src/index.ts")) == {"src/dead.ts", "src/lib/reindex.ts", "App.tsx"}
    assert paths(analyzers.unreferenced_files(facts, include_entry_dirs=True)) == {"src/dead.ts", "src/lib/reindex.ts"}
    assert paths(analyzers.unreferenced_files(facts, "src/dead.ts", include_entry_dirs=True)) == {"src/index.ts", "src/lib/reindex.ts", "App.tsx"}
    assert paths(analyzers.unreachable_files(facts, "src/index.ts")) == {"src/dead.ts", "src/kept.ts", "src/lib/reindex.ts", "App.tsx", "src/self.ts"}


def test_dead_files_are_searched_from_the_entry_points(spark):
    files = {"src/index.ts": "import './used'", "src/used.ts": "", "src/dead.ts": "import './kept'", "src/kept.ts": "", "src/self.ts": "import './self'", "lib/a.ts": "import './b'", "lib/b.ts": "import './a'"}
    facts = analyzers.facts_of(spark.createDataFrame([(p, len(c), c) for p, c in files.items()], "path string, size_bytes long, content string"), spark.createDataFrame([], "alias string, target string"))
    far = {("lib/a.ts", "suspicious", True), ("lib/b.ts", "suspicious", True)}
    assert as_set(analyzers.dead_files(facts, "src/index.ts"), "path", "verdict", "referenced") == far | {("src/dead.ts", "unreferenced", False), ("src/kept.ts", "unreferenced", True), ("src/self.ts", "unreferenced", False)}
    assert as_set(analyzers.dead_files(facts, "src/index.ts", include_entry_dirs=True), "path", "verdict", "referenced") == far
    assert [tuple(r) for r in analyzers.unreferenced_stats(facts, entrypoint="src/index.ts").collect()] == [(7, 3, 2, 3)]


def test_installed_versions_and_places_of_implicit_dependencies(spark, facts):
    installed = spark.createDataFrame([("node_modules/react/package.json", '{"version": "18.3.1"}'), ("node_modules/@types/x/package.json", '{"version": "1.0.0"}')], "path string, content string")
    registry = spark.createDataFrame([("react", "18.3.1"), ("left-pad", "1.3.0")], "name string, latest string")
    got = as_set(analyzers.npm_check(facts, registry, installed).where("problem = 'outdated'"), "name", "detail")
    assert got == {("left-pad", "1.0.0 < 1.3.0")}
    assert as_set(analyzers.implicit_dependencies(facts), "name", "path", "raw") == {("axios", "src/panel/Panel.tsx", "import axios from 'axios'")}


def test_dependencies(spark, facts):
    registry = spark.createDataFrame([("react", "19.0.0")], "name string, latest string")
    assert as_set(analyzers.npm_check(facts, registry), "name", "problem") == {("axios", "implicit"), ("left-pad", "unused"), ("react", "outdated")}


def test_trace_through_assignments(facts):
    assert as_set(analyzers.trace(facts, "react"), "path", "symbol") == {("src/panel/Panel.tsx", "React"), ("src/panel/Panel.tsx", "R")}


def test_component_edges_and_impact(spark, facts, components):
    assert as_set(analyzers.component_edges(facts, components), "src", "dst") == {("app", "panel"), ("panel", "app")}
    changed = spark.createDataFrame([("src/math.ts", 2)], "path string, line int")
    assert as_set(analyzers.changed_symbols(facts, changed), "path", "name") == {("src/math.ts", "twice")}
    assert as_set(analyzers.file_impact(facts, changed), "path", "level") == {("src/main.tsx", 1), ("src/panel/Panel.tsx", 1), ("src/math.test.ts", 1), ("src/panel/index.ts", 2)}
    assert as_set(analyzers.component_impact(facts, components, changed), "component", "level") >= {("app", 0)}


def test_listed_files_and_registry(facts):
    assert as_set(analyzers.css_files(facts), "path") == {("styles/a.scss",)}
    assert set(analyzers.analyze(["count-any", "md-file"], facts)) == {"count-any", "md-file"}
    with pytest.raises(ValueError):
        analyzers.analyze(["nothing"], facts)


def test_diff_lines(spark):
    diff = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -1,3 +1,4 @@\n one\n-two\n+zwei\n+\n+drei\n three\ndiff --git a/p.png b/p.png\nBinary files a/p.png and b/p.png differ\n"
    got = as_set(changed_lines(spark.createDataFrame([(diff,)], "text string")), "path", F.col("line").cast("int"))
    assert got == {("x.ts", 2), ("x.ts", 4), ("p.png", 0)}
