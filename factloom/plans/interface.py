"""Queries over a second generated project: a component with tags for each supplier, in forms that are easily misread, with the same questions in SQL on the table.

Each component takes the one before it as a tag and its enumeration under another name; texts of tags, regular expressions, templates, keys and constructors hold what looks like types, assertions and calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import analyzers, binding, navigation
from factloom.sources import diff
from factloom.tables import CLEANED, durable, grown, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_MADE: dict[tuple, analyzers.Facts] = {}

#: Lines of a file as SQL that Spark and DuckDB both read; k is the supplier, p the one before, q the folder of that.
LINES = [
    "case when p is null then '// first: any' else 'import S' || p || ', { Kind as K } from \"../' || q || '/s' || p || '\"' end",
    "'import * as all from \"pkg-' || n || '\"'",
    "'export enum Kind { A, B }'",
    "'export type Props = { kind: Kind, note?: any }'",
    "'const cfg = { any: 1, as: 2 }, re = /[\"(]any/'",
    "'export default function S' || k || '(props: Props): any {'",
    "case when p is null then '  return <b title=\"x\">so: any {all.get?.(props as any)}</b>' else '  return <S' || p || ' kind={K.A} {...props}>so: any (x as any) {all.get?.(props as any)}</S' || p || '>' end",
    "'}'",
    "'new Foo(' || k || ').run(cfg)'",
    "'f(`a ${g(' || k || ' as number)} b`).then(cb)'",
]
_FIELDS = "cast(s_suppkey as {text}) as k, cast(s_nationkey as {text}) as n, 'n' || cast(s_nationkey as {text}) as folder, s_suppkey as key, 'ui/n' || cast(s_nationkey as {text}) || '/s' || cast(s_suppkey as {text}) || '.tsx' as path"


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content, size_bytes) of the project."""
    own = table(spark, d, "supplier").selectExpr(*[x.strip() for x in _FIELDS.format(text="string").split(", ")])
    before = own.select((F.col("key") + 1).alias("key"), F.col("k").alias("p"), F.col("folder").alias("q"))
    text = F.concat_ws("\n", *[F.expr(x) for x in LINES])
    return own.join(grown(before), "key", "left").select("path", text.alias("content")).withColumn("size_bytes", F.length("content"))


def facts(spark: SparkSession, d: str) -> analyzers.Facts:
    """The facts of the project; found once a session and folder, and again after cleanup()."""
    key = (spark.sparkContext.applicationId, CLEANED[0], d)
    if key not in _MADE:
        _MADE[key] = analyzers.Facts(durable(files(spark, d), "interface"), spark.createDataFrame([], "alias string, target string"))
    return _MADE[key]


_BASE = "own as (select " + _FIELDS.format(text="varchar") + " from supplier), f as (select own.*, b.k as p, b.folder as q, b.path as before_path, a.path as next_path from own left join own b on b.key = own.key - 1 left join own a on a.key = own.key + 1), l as (select *, " + ", ".join(f"{x} as l{i}" for i, x in enumerate(LINES, 1)) + " from f)"


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = f"with {_BASE} {sql}"
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query("""select path, 4 as line, strpos(l4, '?:') + 2 as "column", l4 as raw from l union all select path, 6, strpos(l6, '):') + 2, l6 from l union all select path, 7, strpos(l7, 'props as any') + 8, trim(l7) from l""")
def interface_any(spark, d):
    return facts(spark, d)["any"].withColumn("line", F.col("line").cast("int")).withColumn("column", F.col("column").cast("long"))


@_query("""select path, 7 as line, strpos(l7, 'props as any') as "column", trim(l7) as raw from l union all select path, 10, strpos(l10, 'g(') + 2, l10 from l""")
def interface_as(spark, d):
    return facts(spark, d)["as"].withColumn("column", F.col("column").cast("long"))


@_query("""select path, 7 as line, ['all', 'get'] as chain, 'props as any' as argument from l union all select path, 9, ['new Foo(' || k || ')', 'run'], 'cfg' from l union all select path, 10, ['f'], '`a ${g(' || k || ' as number)} b`' from l
    union all select path, 10, ['g'], k || ' as number' from l union all select path, 10, ['f(`a ${g(' || k || ' as number)} b`)', 'then'], 'cb' from l""")
def interface_calls(spark, d):
    return facts(spark, d)["calls"]


@_query("""select path, 7 as line, case when p is null then 'b' else 'S' || p end as component, case when p is null then ['title'] else ['kind'] end as attributes, case when p is null then [] else ['props'] end as spread, before_path as src_path from f""")
def interface_tags(spark, d):
    return facts(spark, d)["jsx"].select("path", "line", "component", "attributes", "spread", "src_path")


@_query("""select path, 'default' as import_module, 'default' as module_type, 'S' || p as identifier, before_path as src_path, cast(null as varchar) as npm_pkg from f where p is not null
    union all select path, 'Kind', 'named', 'K', before_path, null from f where p is not null union all select path, '*', 'namespace', 'all', null, 'pkg-' || n from f""")
def interface_imports(spark, d):
    return facts(spark, d)["imports"].select("path", "import_module", "module_type", "identifier", "src_path", "npm_pkg")


@_query("""select path, 'Kind' as name, 'enum' as kind, 3 as start_line, 3 as end_line, true as exported, 'named' as export_type from f union all select path, 'Props', 'type', 4, 4, true, 'named' from f
    union all select path, 'cfg', 'variable', 5, 5, false, null from f union all select path, 're', 'variable', 5, 5, false, null from f union all select path, 'S' || k, 'function', 6, 8, true, 'default' from f""")
def interface_symbols(spark, d):
    return facts(spark, d)["symbols"]


@_query("""select path, 'Props' as type, 'Kind' as reference, ['kind'] as places from f""")
def interface_type_references(spark, d):
    return facts(spark, d)["type_refs"]


@_query("""select path, 'Props' as name, 'type' as kind, 4 as line from f union all select path, 'Kind', 'enum', 3 from f where next_path is null union all select path, 'default', 'default', 6 from f where next_path is null""")
def interface_unconsumed(spark, d):
    return analyzers.unconsumed_exports(facts(spark, d))


@_query("""select path, 'Kind' as name, 3 as line, 2 + 2 * (next_path is not null)::int as "references", 1 + (next_path is not null)::int as files from f union all select path, 'Props', 4, 2, 1 from f
    union all select path, 'cfg', 5, 2, 1 from f union all select path, 're', 5, 1, 1 from f union all select path, 'S' || k, 6, 1 + 2 * (next_path is not null)::int, 1 + (next_path is not null)::int from f""")
def interface_references(spark, d):
    """Uses by scope: the enumeration under its other name, a component as the tag of the next one."""
    return binding.reference_counts(facts(spark, d))


@_query("""select path, 3 as line, strpos(l3, 'Kind') as "column", 'Kind' as name, path as ref_path, 3 as ref_line, strpos(l3, 'Kind') as ref_column, 'Kind' as ref_name from l where key % 10 = 0
    union all select path, 3, strpos(l3, 'Kind'), 'Kind', path, 4, strpos(l4, 'Kind'), 'Kind' from l where key % 10 = 0
    union all select a.path, 3, strpos(a.l3, 'Kind'), 'Kind', b.path, 1, strpos(b.l1, ' K ') + 1, 'K' from l a join l b on b.key = a.key + 1 where a.key % 10 = 0
    union all select a.path, 3, strpos(a.l3, 'Kind'), 'Kind', b.path, 7, strpos(b.l7, 'K.A'), 'K' from l a join l b on b.key = a.key + 1 where a.key % 10 = 0""")
def interface_find_references(spark, d):
    """Every place that means the enumeration of each tenth component, asked for by position."""
    points = table(spark, d, "supplier").where("s_suppkey % 10 = 0").selectExpr("concat('ui/n', s_nationkey, '/s', s_suppkey, '.tsx') as path", "3 as line", "13 as column")
    out = binding.find_references(facts(spark, d), points).withColumn("name", F.lit("Kind"))
    return out.withColumn("column", F.col("column").cast("long")).withColumn("ref_column", F.col("ref_column").cast("long"))


@_query("""select path, 'function' as kind, 'S' || k as name from f union all select path, 'enum', 'Kind' from f union all select path, 'variable', 'cfg' from f""")
def interface_symbol_at(spark, d):
    """The declarations around lines 3, 5 and 7."""
    points = facts(spark, d)["files"].select("path", F.explode(F.array(F.lit(3), F.lit(5), F.lit(7))).alias("line"))
    found = navigation.symbol_at(facts(spark, d)["nodes"], points).select("path", "kind", "name")
    return found.withColumn("name", F.when(F.col("name") == "re", "cfg").otherwise(F.col("name")))


@_query("""select path, cast(key + 1 as integer) as line from f where key % 3 = 0 union all select path, cast(key + 2 as integer) from f where key % 3 = 0 union all select path, 0 from f where key % 3 = 1""")
def interface_changed_lines(spark, d):
    """Added lines of a unified diff for each folder: two lines in every third file, a binary one next to it."""
    own = table(spark, d, "supplier").selectExpr(*[x.strip() for x in _FIELDS.format(text="string").split(", ")])
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"))
    hunk = F.concat(head, F.lit("@@ -7,2 +"), F.col("key").cast("string"), F.lit(",3 @@ f\n one\n+two\n-gone\n+three\n+\n"))
    block = F.when(F.col("key") % 3 == 0, hunk).when(F.col("key") % 3 == 1, F.concat(head, F.lit("Binary files differ\n"))).otherwise(F.concat(head, F.lit("@@ -1 +1 @@\n-a\n")))
    return diff.changed_lines(own.groupBy("folder").agg(F.array_join(F.collect_list(block), "").alias("text")).select("text"))
