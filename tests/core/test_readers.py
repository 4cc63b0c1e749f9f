"""Data sources: odd folder names, folders that are never listed, pushed filters, diffs between revisions and of saved merge requests."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from factloom.sources import code_facts, diff, readers

TREE = [
    "src/pages/[id]/a b.ts", "src/{x}/*.ts", "src/it's/\"q\".tsx", "src/é/ü.ts", "top.ts", "src/a.test.ts", "node_modules/p/x.ts", "packages/q/node_modules/r/y.ts", "src/__test__/z.ts", ".git/config", "dist/out.js",
    "src/build/o.js", "deep/1/2/3/4/5/6/f.ts", "public/p.js", "src/proj/src/proj/g.ts",
]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for name in TREE:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"// {name}", encoding="utf-8")
    return root


def test_scan_of_odd_names(spark, tree):
    got = {r.path: r.content for r in code_facts.scan(spark, str(tree)).collect()}
    gone = ("src/a.test.ts", "node_modules/p/x.ts", "packages/q/node_modules/r/y.ts", "src/__test__/z.ts", ".git/config")
    assert got == {p: f"// {p}" for p in TREE if p not in gone}
    parsed = {r.path for r in code_facts.scan_project(spark, f"file://{tree}/").select("path").collect()}
    assert parsed == got.keys() - {"dist/out.js", "src/build/o.js", "public/p.js"}


def test_ignored_folders_are_never_listed(spark, tree):
    os.chmod(tree / "node_modules", 0)
    try:
        reader = readers.TreeReader(str(tree), code_facts.SCAN_IGNORED, [], 3)
        listed, plain = [], reader._list
        reader._list = lambda store, base, folder, patterns: listed.append(folder) or plain(store, base, folder, patterns)
        shares = reader.partitions()
        paths = {p for s in shares for b in reader.read(s) for p in b.column(0).to_pylist()}
    finally:
        os.chmod(tree / "node_modules", 0o755)
    assert not [f for f in listed if "node_modules" in f or ".git" in f or "__test__" in f] and "deep/1/2/3/4/5/6/f.ts" in paths and len(shares) > 2


@pytest.mark.parametrize("splits", [1, 2, 1000])
def test_every_file_once_however_split(tree, splits):
    reader = readers.TreeReader(str(tree), [], [], splits)
    paths = [p for s in reader.partitions() for b in reader.read(s) for p in b.column(0).to_pylist()]
    assert sorted(paths) == sorted(TREE)


def test_pushed_filters_narrow_the_walk(spark, tree):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = readers.source_tree(spark, str(tree))
        assert {r.path for r in rows.where(F.col("path").startswith("src/p")).collect()} == {"src/pages/[id]/a b.ts", "src/proj/src/proj/g.ts"}
        assert [r.path for r in rows.where("path = 'top.ts'").collect()] == ["top.ts"]
        assert {r.path for r in rows.where("path in ('top.ts', 'deep/1/2/3/4/5/6/f.ts', 'no')").collect()} == {"top.ts", "deep/1/2/3/4/5/6/f.ts"}
        assert rows.where("size_bytes > 1000").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = readers.FilteredTreeReader(str(tree), [], [], 4)
    list(reader.pushFilters([readers.StringStartsWith(("path",), "deep/")]))
    listed, plain = [], reader._list
    reader._list = lambda store, base, folder, patterns: listed.append(folder) or plain(store, base, folder, patterns)
    assert [p for s in reader.partitions() for b in reader.read(s) for p in b.column(0).to_pylist()] == ["deep/1/2/3/4/5/6/f.ts"]
    assert all(f == "" or f.startswith("deep") for f in listed)
    assert {r.path for r in readers.source_tree(spark, str(tree), prefix="src/é").collect()} == {"src/é/ü.ts"}


def test_diff_between_revisions(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    for name in ("a.ts", "dir/é b.ts", "same.ts", "gone.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("one\ntwo\n")
    git("add", "."), git("commit", "-qm", "1"), git("checkout", "-qb", "work")
    (tmp_path / "a.ts").write_text("one\nnew\ntwo\n")
    (tmp_path / "dir/é b.ts").write_text("one\ntwo\nthree\n")
    (tmp_path / "fresh.ts").write_text("x\n\ny\n")
    git("rm", "-q", "gone.ts"), git("add", "."), git("commit", "-qm", "2")
    got = diff.changed_lines(diff.diff_texts(spark, "revision", "main...work", str(tmp_path)))
    assert {tuple(r) for r in got.collect()} == {("a.ts", 2), ("dir/é b.ts", 3), ("fresh.ts", 1), ("fresh.ts", 3)}
    assert {r.path for r in diff.changed_files(diff.diff_texts(spark, "revision", "main", str(tmp_path))).collect()} == {"a.ts", "dir/é b.ts", "fresh.ts", "gone.ts"}
    assert diff.diff_texts(spark, "revision", "work...work", str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        readers.RevisionReader(".", "--output=x", "HEAD")


def test_saved_merge_requests(spark, tmp_path):
    change = {"old_path": "a.ts", "new_path": "b.ts", "diff": "@@ -1 +1,2 @@\n one\n+two\n"}
    (tmp_path / "1.json").write_text(json.dumps({"iid": 7, "changes": [change, {"old_path": "c.ts", "new_path": "c.ts", "diff": None}]}))
    (tmp_path / "2.json").write_text(json.dumps([{"old_path": "d.ts", "new_path": "d.ts", "diff": "@@ -0,0 +1 @@\n+x\n"}]))
    texts = diff.diff_texts(spark, "api", str(tmp_path))
    assert {tuple(r) for r in diff.changed_lines(texts).collect()} == {("b.ts", 2), ("d.ts", 1)}
    assert {r.path for r in diff.changed_files(texts).collect()} == {"a.ts", "c.ts", "d.ts"}
    assert {r.iid for r in diff.merge_request_changes(spark, str(tmp_path)).collect()} == {7, None}
