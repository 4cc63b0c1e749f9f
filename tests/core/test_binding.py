"""The structural join against all pairs, and scoped references over shadowing, imports and re-exports."""

import random
import time

import pytest

from factloom.operators import analyzers, binding, navigation
from factloom.operators.containment import enclosing
from factloom.plans import interface
from factloom.sources import code_facts
from factloom.sources.names import Names


def pairs(outer, inner, nearest):
    out = set()
    for path, item, pos, end in inner:
        around = sorted((e - p, -i, i) for q, i, p, e in outer if q == path and p <= pos and end <= e)
        for distance, (_, _, i) in enumerate(around[: 1 if nearest else None], 1):
            out.add((path, item, i, distance))
    return out


@pytest.mark.parametrize("nearest", [False, True])
def test_enclosing_equals_all_pairs(spark, nearest):
    rng = random.Random(1)
    outer, inner = [], []

    def nest(path, a, b, depth):
        outer.append((path, len(outer), a, b))
        while depth and b - a > 2 and rng.random() < 0.8:
            x = rng.randint(a, b - 1)
            nest(path, x, rng.randint(x + 1, b), depth - 1)
            a = outer[-1][3] if rng.random() < 0.5 else b

    for path in "abc":
        for k in range(5):
            nest(path, k * 100, k * 100 + 99, 6)
        inner += [(path, k, p, p + rng.randint(1, 9)) for k, p in enumerate(rng.sample(range(520), 80))]
    got = enclosing(spark.createDataFrame(outer, "path string, id int, pos int, end int"), spark.createDataFrame(inner, "path string, item int, pos int, end int"), nearest)
    laminar = {tuple(r) for r in got.collect()}
    want = pairs(outer, inner, nearest)
    assert {r[:3] for r in laminar} == {r[:3] for r in want} if not nearest else len(laminar) == len(want)


def test_crossing_extents_and_equal_ones(spark):
    outer = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 5, 15), ("a", 3, 5, 15), ("b", 4, 0, 3)], "path string, id int, pos int, end int")
    inner = spark.createDataFrame([("a", 1, 6, 8), ("a", 2, 9, 12), ("a", 3, 5, 15), ("b", 4, 3, 4), ("c", 5, 0, 1)], "path string, item int, pos int, end int")
    assert {tuple(r) for r in enclosing(outer, inner).collect()} == {("a", 1, 3, 1), ("a", 1, 2, 2), ("a", 1, 1, 3), ("a", 2, 3, 1), ("a", 2, 2, 2), ("a", 3, 3, 1), ("a", 3, 2, 2)}
    assert {tuple(r) for r in enclosing(outer, outer.withColumnRenamed("id", "item"), one_table=True).collect()} == {("a", 3, 2, 1)}


def test_a_file_of_50000_nodes(spark):
    text = "".join(f"export function f{i}() {{ const a = g{i}(1); return a }}\n" for i in range(12_500))
    nodes = code_facts.nodes(spark.createDataFrame([("a.ts", text)], "path string, content string")).cache()
    assert nodes.count() == 50_000 and navigation.ancestors(nodes).count() == 50_000
    at = navigation.node_at(nodes, spark.range(0, 400_000, 7).selectExpr("'a.ts' as path", "cast(id as int) as offset"))
    assert at.where("kind = 'call'").count() > 1000
    nodes.unpersist()


FILES = {
    "a.ts": """export const total = 1
export function sum(total: number, other = total) {
  const inner = total + other
  if (inner) { const total = 2; return total }
  for (const other of [inner]) { log(other) }
  return [1].map(total => total + inner)
}
export const twice = total * 2
class Box<T> { total = total; get(total: T): T { return this.total ?? total } }
export type Pair = { total: typeof total; sum: (total: Box<string>) => number }
const { total: renamed, ...others } = { total, twice }
try { sum(1) } catch (sum) { log(sum) }
function hoist() { if (renamed) { var late = others } return late }
""",
    "index.ts": "export { total as grand } from './a'\nexport * from './a'\n",
    "b.tsx": "import { grand, sum as add } from './index'\nimport * as all from './a'\nexport const C = () => <Panel value={grand} grand={add(grand)} />\nfunction Panel({ grand }: { grand: number }) { return <b>{grand} grand</b> }\nlet x = `${grand}` // grand\nconst o = { grand, add: 1, [grand]: add }\nall.total\n",
    "c.ts": "const grand = 5\nexport default grand\n",
    "d.ts": "import grand from './c'\ngrand\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    return analyzers.facts_of(spark.createDataFrame([(p, c, len(c)) for p, c in FILES.items()], "path string, content string, size_bytes long"), spark.createDataFrame([], "alias string, target string"))


def references(spark, facts, path, line, word, nth=0):
    text = FILES[path].split("\n")[line - 1]
    column = -1
    for _ in range(nth + 1):
        column = text.index(word, column + 1)
    points = spark.createDataFrame([(path, line, column + 1)], "path string, line int, column int")
    return sorted((r.ref_path, r.ref_line, r.ref_column) for r in binding.find_references(facts, points).collect())


def places(*given):
    """(path, line, nth occurrence of the word) to places."""
    out = []
    for path, line, word, nth in given:
        text, column = FILES[path].split("\n")[line - 1], -1
        for _ in range(nth + 1):
            column = text.index(word, column + 1)
        out.append((path, line, column + 1))
    return sorted(out)


def test_a_shadowed_name_is_another_one(spark, facts):
    assert references(spark, facts, "a.ts", 4, "total", 0) == places(("a.ts", 4, "total", 0), ("a.ts", 4, "total", 1))
    assert references(spark, facts, "a.ts", 3, "total") == places(("a.ts", 2, "total", 0), ("a.ts", 2, "total", 1), ("a.ts", 3, "total", 0))
    assert references(spark, facts, "a.ts", 6, "total", 1) == places(("a.ts", 6, "total", 0), ("a.ts", 6, "total", 1))
    assert references(spark, facts, "a.ts", 12, "sum", 2) == places(("a.ts", 12, "sum", 1), ("a.ts", 12, "sum", 2))
    assert references(spark, facts, "a.ts", 5, "other", 0) == places(("a.ts", 5, "other", 0), ("a.ts", 5, "other", 1))
    assert references(spark, facts, "a.ts", 13, "late", 0) == places(("a.ts", 13, "late", 0), ("a.ts", 13, "late", 1))


def test_references_follow_imports_and_re_exports(spark, facts):
    want = places(
        ("a.ts", 1, "total", 0), ("a.ts", 8, "total", 0), ("a.ts", 9, "total", 1), ("a.ts", 10, "total", 1), ("a.ts", 11, "total", 1),
        ("b.tsx", 1, "grand", 0), ("b.tsx", 3, "grand", 0), ("b.tsx", 3, "grand", 2), ("b.tsx", 5, "grand", 0), ("b.tsx", 6, "grand", 0), ("b.tsx", 6, "grand", 1),
    )
    assert references(spark, facts, "a.ts", 8, "total") == want
    assert references(spark, facts, "b.tsx", 5, "grand") == want
    assert references(spark, facts, "d.ts", 2, "grand") == places(("c.ts", 1, "grand", 0), ("c.ts", 2, "grand", 0), ("d.ts", 1, "grand", 0), ("d.ts", 2, "grand", 0))


def test_goto_definition_by_position(spark, facts):
    points = spark.createDataFrame([("b.tsx", 3, 33), ("b.tsx", 3, 46), ("b.tsx", 4, 65), ("d.ts", 2, 3), ("a.ts", 5, 1)], "path string, line int, column int")
    got = {(r.path, r.line, r.column): (r.name, r.def_path, r.def_line, r.def_column) for r in binding.goto_definition(facts, points).collect()}
    assert got[("d.ts", 2, 3)] == ("grand", "c.ts", 1, 7) and ("a.ts", 5, 1) not in got
    assert {v[:3] for v in got.values()} >= {("grand", "c.ts", 1)}
    counts = {(r.path, r.name): (r.references, r.files) for r in binding.reference_counts(facts).collect()}
    assert counts[("a.ts", "total")] == (11, 2) and counts[("c.ts", "grand")] == (4, 2)


def test_lines_without_semicolons_end_declarations():
    text = "const f = (a: number): any => { return g(a) }\nconst h = [1, 2]\nlet k = x => x(h)\nother = k\nconst m = a\n  instanceof B, n = 2\n"
    rows = Names(text).rows
    assert [(r[1], r[2]) for r in rows if r[0] == "binding" and r[2] in ("const", "let")] == [("f", "const"), ("h", "const"), ("k", "let"), ("m", "const"), ("n", "const")]
    assert ("scope", "function", "", text.index("x =>"), text.index("\nother")) in rows


def test_reading_names_is_linear():
    unit = "export const v%d = (a: number): any => { return f(a as T, { x: [1, 2] }) }\ninterface I%d { a: string; b?: Foo<Bar> }\n"
    for text in ("".join(unit % (i, i) for i in range(9000)), "const a = b\n" * 40000, "x => " * 3000, "(" * 30000, "import { " + "a, " * 40000 + "} from 'x'"):
        began = time.time()
        Names(text)
        assert time.time() - began < 12


def test_names_of_odd_sources():
    for text in ("", "}", "function", "import {", "const {", "(", "a =>", "catch (", "for (", "export {", "`${", "<A", "class", "import * as", "const a: Map<", "type ="):
        Names(text)
    rng = random.Random(4)
    parts = ["a", "b", "(", ")", "{", "}", "[", "]", "<", ">", "=", "=>", " as ", ": T", "`", "${", "'", "/", "\n", ";", ",", "const ", "function ", "class ", "import ", "export ", "type ", ".", "?", "<p>", "</p>", "catch ", "for "]
    for _ in range(3000):
        Names("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))))


def test_facts_are_joined_without_a_broadcast_of_them(spark):
    """A compressed table of facts is far smaller on disk, by which Spark plans, than in the driver's memory, through which a broadcast goes."""
    files = spark.createDataFrame([(f"src/f{i}.ts", f"import {{ a as b }} from './f{i - 1}'\nexport const a = (c: number) => b + c", 70) for i in range(20)], "path string, content string, size_bytes long")
    facts = analyzers.facts_of(files, spark.createDataFrame([], "alias string, target string"))
    wanted = facts["imports"].select("path", "specifier")
    plans = {
        "bindings": binding.bound_names(facts["names"]), "uses": binding.resolved_uses(facts["names"], facts["bindings"]), "counts": binding.reference_counts(facts),
        "resolve": code_facts.resolve(wanted, facts["files"].select("path"), spark.createDataFrame([], "alias string, target string")), "symbols": code_facts.symbols(facts["nodes"], facts["exports"]),
    }
    for name, frame in plans.items():
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        # Only the aliases of a configuration are sent to every task.
        assert plan.count("BroadcastHashJoin") == (name == "resolve") and "BuildLeft" not in plan, (name, plan)
    assert {(r.name, r.references, r.files) for r in binding.reference_counts(facts).collect()} == {("a", 3, 2), ("a", 1, 1)}


def test_files_of_components_are_made_without_a_broadcast_of_them(spark):
    plan = interface.files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan
