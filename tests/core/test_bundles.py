"""Bundles by entry: shared types, aliases, declaration files of packages, and one file for each entry."""

import pytest

from factloom.operators import analyzers, bundle
from factloom.sources.writers import write_named_files

FILES = {
    "src/user.ts": "export interface User { id: Id; role: Role }\nexport type Id = string\nexport enum Role { A }\n", "src/item.ts": "import type { User } from './user'\nexport interface Item { owner: User; tags: Tag[] }\ninterface Tag { n: Id }\ninterface Id { v: number }\n",
    "src/index.ts": "export * from './item'\nexport { User as Person } from './user'\n", "src/remote.ts": "import { Remote, Opts as O } from 'remote'\nimport type { Node } from '@scope/tree/node'\nexport interface Call { r: Remote; o: O; n: Node; g: Global }\n",
    "src/global.d.ts": "interface Global { x: number }\n",
}
INSTALLED = {
    "node_modules/remote/package.json": '{"name": "remote", "types": "./lib/main.d.ts", "dependencies": {"base": "1"}}', "node_modules/remote/lib/main.d.ts": "import { Base } from 'base'\nexport * from './opts'\nexport interface Remote extends Base { u: User }\ninterface User { local: true }\n",
    "node_modules/remote/lib/opts.d.ts": "export type Opts = { deep: Inner }\nexport interface Inner { n: 1 }\n", "node_modules/base/package.json": '{"name": "base"}', "node_modules/@types/base/index.d.ts": "export interface Base { b: string }\n",
    "node_modules/@scope/tree/package.json": "{}", "node_modules/@scope/tree/node.d.ts": "export interface Node { up?: Node }\n", "node_modules/unused/package.json": "{}", "node_modules/unused/index.d.ts": "export interface Global { wrong: 1 }\n",
}


def frame(spark, files):
    return spark.createDataFrame([(p, c, len(c)) for p, c in files.items()], "path string, content string, size_bytes long")


@pytest.mark.parametrize("configured", [False, True])
def test_bundles_by_entry_and_files(spark, tmp_path, configured):
    aliases = spark.createDataFrame([("", " ", "")], "config_dir string, alias string, target string") if configured else spark.createDataFrame([], "alias string, target string")
    facts = bundle.with_packages(frame(spark, FILES), aliases, frame(spark, INSTALLED))
    assert facts["files"].where("path like '%unused%'").count() == 0
    entries = bundle.entries_of(spark.createDataFrame([("src/index.ts:Item",), ("src/user.ts:User:Account",), ("src/index.ts:Person",), ("src/remote.ts:Call",)], "entry string"))
    rows = bundle.bundles(facts, entries)
    got = {}
    for r in rows.collect():
        got.setdefault(r.entry, {})[(r.path, r.type)] = (r.final_name, r.text)
    assert set(got["src/index.ts:Item"]) == {("src/item.ts", "Item"), ("src/item.ts", "Tag"), ("src/item.ts", "Id"), ("src/user.ts", "User"), ("src/user.ts", "Id"), ("src/user.ts", "Role")}
    # Two types of one name inside one entry only: the other entries keep plain names.
    assert got["src/index.ts:Item"][("src/user.ts", "Id")][0] == "Id_user" and "id: Id_user" in got["src/index.ts:Item"][("src/user.ts", "User")][1]
    assert got["src/user.ts:User"][("src/user.ts", "User")] == ("Account", "export interface Account { id: Id; role: Role }") and got["src/user.ts:User"][("src/user.ts", "Id")][0] == "Id"
    assert set(got["src/index.ts:Person"]) == set(got["src/user.ts:User"])
    call = got["src/remote.ts:Call"]
    assert set(call) == {
        ("src/remote.ts", "Call"), ("src/global.d.ts", "Global"), ("node_modules/remote/lib/main.d.ts", "Remote"), ("node_modules/remote/lib/main.d.ts", "User"), ("node_modules/remote/lib/opts.d.ts", "Opts"),
        ("node_modules/remote/lib/opts.d.ts", "Inner"), ("node_modules/@types/base/index.d.ts", "Base"), ("node_modules/@scope/tree/node.d.ts", "Node"),
    }
    assert "o: Opts" in call[("src/remote.ts", "Call")][1]
    bundle.write_bundles(rows, str(tmp_path / "out"))
    files = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.ts")}
    assert set(files) == {"src/index.Item.d.ts", "src/user.User.d.ts", "src/index.Person.d.ts", "src/remote.Call.d.ts"}
    assert "export interface Account" in files["src/user.User.d.ts"] and "export interface Tag" in files["src/index.Item.d.ts"] and files["src/index.Item.d.ts"].index("interface Id ") < files["src/index.Item.d.ts"].index("interface Item")


def test_shared_circles(spark):
    files = {"a.ts": "import { B } from './b'\nexport interface A { b: B }", "b.ts": "import { A } from './a'\nexport interface B { a: A; c: C }\nexport interface C { n: number }"}
    facts = analyzers.facts_of(frame(spark, files), spark.createDataFrame([], "alias string, target string"))
    rows = bundle.closures(facts, spark.createDataFrame([("a.ts", "A"), ("b.ts", "B"), ("b.ts", "C"), ("b.ts", "None")], "path string, type string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.entry, set()).add(r.type)
    assert got == {"a.ts:A": {"A", "B", "C"}, "b.ts:B": {"A", "B", "C"}, "b.ts:C": {"C"}}


def test_named_files(spark, tmp_path):
    folder = str(tmp_path / "f")
    write_named_files(spark.createDataFrame([(f"d{i % 3}/n {i}.txt", "é" * i) for i in range(20)], "name string, text string").repartition(4), folder)
    assert sorted(p.name for p in (tmp_path / "f").rglob("*.txt")) == sorted(f"n {i}.txt" for i in range(20)) and (tmp_path / "f/d1/n 4.txt").read_text() == "éééé"
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["d0", "d1", "d2"]
    for bad in ([("../x", "t")], [("/x", "t")], [("", "t")], [("a", "1"), ("a", "2")]):
        with pytest.raises(Exception, match="name"):
            write_named_files(spark.createDataFrame(bad, "name string, text string"), folder)
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["d0", "d1", "d2"]
