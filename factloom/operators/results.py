"""Results of analyzers: a frame with a summary, and the ways to write it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.versions import Versions


@dataclass
class Result:
    """What an analyzer found. stats is a frame of one row, or None."""

    name: str
    df: DataFrame
    stats: DataFrame | None = None

    def summary(self) -> dict:
        row = (self.stats if self.stats is not None else self.df.agg(F.count("*").alias("rows"))).first()
        return row.asDict()

    def to_json(self) -> DataFrame:
        """(value): one JSON text a row."""
        return self.df.select(F.to_json(F.struct(*self.df.columns)).alias("value"))

    def show(self, n: int = 20) -> None:
        print(self.name, self.summary())
        self.df.show(n, truncate=False)

    def write(self, folder: str) -> None:
        """Lines of JSON below folder."""
        self.to_json().write.mode("overwrite").text(folder)


def run(name: str, facts, **params) -> Result:
    """One analyzer with its summary."""
    from factloom.operators import analyzers

    frame = analyzers.analyze([name], facts, {name: params})[name]
    stats = {
        "count-any": lambda: analyzers.finding_stats(facts, "any"), "count-as": lambda: analyzers.finding_stats(facts, "as"), "unconsumed": lambda: analyzers.unconsumed_stats(facts),
        "find-unreferenced-files": lambda: analyzers.unreferenced_stats(facts, **params),
    }.get(name)
    return Result(name, frame, stats() if stats else None)


def all_as_json(results: list[Result]) -> DataFrame:
    """(analyzer, value) of several results."""
    return reduce(DataFrame.union, [r.to_json().select(F.lit(r.name).alias("analyzer"), "value") for r in results])


def relative_to(df: DataFrame, root: str, *columns: str) -> DataFrame:
    """df with paths below root made relative."""
    head = root.rstrip("/") + "/"
    return df.withColumns({c: F.when(F.col(c).startswith(head), F.substring(c, len(head) + 1, 1 << 30)).otherwise(F.col(c)) for c in columns})


def without_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """df without the named fields: a plain name at any depth, a dotted one from the top; arrays are seen through."""
    names, paths = {f for f in fields if "." not in f}, {f for f in fields if "." in f}

    def kept(column: Column, kind: T.DataType, at: str) -> Column:
        if isinstance(kind, T.StructType):
            inner = [f for f in kind.fields if f.name not in names and f"{at}.{f.name}" not in paths]
            return F.when(column.isNotNull(), F.struct(*[kept(column.getField(f.name), f.dataType, f"{at}.{f.name}").alias(f.name) for f in inner]))
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: kept(x, kind.elementType, at))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            gone = [F.lit(n) for n in names] + [F.lit(p.rpartition(".")[2]) for p in paths if p.rpartition(".")[0] == at]
            return F.map_filter(column, lambda k, _: ~k.isin(*gone)) if gone else column
        return column

    return df.select(*[kept(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields if f.name not in names])


def store(facts, folder: str) -> None:
    """Every fact table as Parquet below folder."""
    for name, df in facts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


#: The tables of a project database: name, fact, columns.
DATABASE = [
    ("packages", "packages", ["workspace", "path"]), ("npm_dependencies", "packages", ["path", "name", "version", "dep_type"]), ("files", "files", ["path"]),
    ("imports", "imports", ["path", "import_module", "module_type", "identifier", "specifier", "src_path", "npm_pkg"]), ("exports", "exports", ["path", "name", "kind", "export_type", "line"]),
    ("interfaces", "members", ["path", "type", "member", "text"]), ("function_calls", "calls", ["path", "line", "chain", "argument"]), ("variables", "variables", ["path", "line", "identifier", "source"]),
]


def store_database(facts, folder: str, fmt: str = "parquet") -> int:
    """The eight tables below folder, each row under a key of its content instead of a counter; all of them become visible together, as a new version. Read them with
    Versions(spark, folder).table(name)."""
    tables = {}
    for table, fact, columns in DATABASE:
        rows = facts[fact].select(*columns).distinct()
        tables[table] = rows.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("id"), *columns)
    return Versions(next(iter(tables.values())).sparkSession, folder).publish(tables, fmt=fmt)


def json_values(rows: DataFrame, path: str, text: str = "value") -> DataFrame:
    """rows with found: the value at a JSON path of the text (`$.a.b[0]`), as JSON; null where there is none. Conditions, sorting and grouping are for DataFrames."""
    return rows.withColumn("found", F.to_json(F.variant_get(F.try_parse_json(text), path, "variant")))


def json_elements(rows: DataFrame, path: str, text: str = "value") -> DataFrame:
    """(source, key, nth, found): one row for each element of the array (or field of the object) at a JSON path of the text; texts without one give none."""
    inner = rows.select(F.col(text).alias("source"), F.variant_get(F.try_parse_json(text), path, "variant").alias("_v"))
    each = rows.sparkSession.tvf.variant_explode(F.col("_v").outer())
    return inner.lateralJoin(each).select("source", "key", F.col("pos").alias("nth"), F.expr("to_json(value)").alias("found"))
