"""Versions become visible whole; kept facts equal a full build, and only what changed is read and resolved."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import analyzers, results
from factloom.operators.incremental import IncrementalFacts
from factloom.plans import project as generated
from factloom.sources.versions import Versions
from factloom.tables import cleanup

FILES = {
    "src/a.ts": "import { b } from './b'\nimport { far } from '@/far'\nimport x from 'pkg'\nexport const a = b as any\n", "src/b.ts": "export const b = 1\n", "src/c.tsx": "export const b = 1\n",
    "src/far/index.ts": "export * from '../b'\nexport const far: any = 2\n", "src/late.ts": "import { later } from './later'\nimport { b } from './c'\n",
}


def frame(spark, files):
    return spark.createDataFrame([(p, c, len(c)) for p, c in files.items()], "path string, content string, size_bytes long")


def rows(df):
    return sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())


def equal_to_a_full_build(spark, facts, files, aliases):
    full = analyzers.facts_of(frame(spark, files), aliases)
    for name in ("nodes", "plain", "imports", "re_exports", "exports", "origins", "any", "symbols", "uses"):
        assert rows(facts[name]) == rows(full[name]), name


def test_an_update_reads_what_changed(spark, tmp_path):
    aliases = spark.createDataFrame([("@", "src")], "alias string, target string")
    store, files = str(tmp_path / "store"), dict(FILES)
    first = IncrementalFacts(frame(spark, files), aliases, store)
    assert (first.parsed, first.resolved) == (5, 6)
    equal_to_a_full_build(spark, first, files, aliases)
    again = IncrementalFacts(frame(spark, files), aliases, store)
    assert (again.parsed, again.resolved) == (0, 0)
    # One file is changed, one moved, one added: the moved one is not read again, and only specifiers that may mean these paths are looked up.
    files["src/b.ts"] = "export const b = 2\nexport const d = 3\n"
    files["src/moved.tsx"] = files.pop("src/c.tsx")
    files["src/later.ts"] = "export const later = 1\n"
    third = IncrementalFacts(frame(spark, files), aliases, store)
    assert (third.parsed, third.resolved) == (2, 2)
    equal_to_a_full_build(spark, third, files, aliases)
    assert {(r.specifier, r.src_path) for r in third["imports"].where("path = 'src/late.ts'").collect()} == {("./later", "src/later.ts"), ("./c", None)}
    # Other aliases: every specifier is looked up, nothing is read.
    moved = spark.createDataFrame([("@", "src/none")], "alias string, target string")
    fourth = IncrementalFacts(frame(spark, files), moved, store)
    assert (fourth.parsed, fourth.resolved) == (0, 6)
    equal_to_a_full_build(spark, fourth, files, moved)
    assert IncrementalFacts(frame(spark, {}), moved, store)["imports"].count() == 0


def test_a_failing_table_leaves_the_old_version(spark, tmp_path):
    facts = analyzers.facts_of(frame(spark, FILES), spark.createDataFrame([("@", "src")], "alias string, target string"))
    folder = str(tmp_path / "db")
    assert results.store_database(facts, folder) == 1
    store = Versions(spark, folder)
    before = rows(store.table("variables"))

    class Broken(dict):
        def __getitem__(self, name):
            df = facts[name]
            return df.withColumn("identifier", F.raise_error(F.lit("lost"))) if name == "variables" else df.limit(0)

    with pytest.raises(Exception, match="lost"):
        results.store_database(Broken(), folder)
    assert store.numbers() == [1] and rows(store.table("variables")) == before and store.table("imports").count() == 5


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    assert store.numbers() == [] and store.manifest()["tables"] == {}
    one = spark.range(3)
    assert store.publish({"a": one, "b": one}, notes={"n": 1}) == 1
    assert store.publish({"a": one.limit(1)}, appended={"b": one}, base=1) == 2
    assert (store.table("a").count(), store.table("b").count(), store.table("a", 1).count()) == (1, 6, 3) and store.manifest()["notes"] == {"n": 1}
    with pytest.raises(RuntimeError):
        store.publish({"a": one}, base=1)
    with pytest.raises(RuntimeError):
        store._put(2, {})
    with pytest.raises(ValueError):
        store.table("a", 9)
    with pytest.raises(KeyError):
        store.table("none")
    store.vacuum()
    assert store.numbers() == [2] and store.table("b").count() == 6 and len(list((tmp_path / "v/data").iterdir())) == 2


def test_queries_survive_cleanup(spark):
    d = "/root/testdata/sf0.001"
    n = generated.queries()["project_count_any"](spark, d).count()
    cleanup(spark)
    assert generated.queries()["project_count_any"](spark, d).count() == n
