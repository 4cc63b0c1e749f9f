"""Relational operators over fact tables. Each is a pure function of DataFrames; Catalyst chooses how joins run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unconsumed(exports: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """Exports that nothing consumes."""
    return exports.join(consumed.select(*keys).distinct(), keys, "left_anti")


def undeclared(used: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, uses) of what is used and not declared."""
    return used.join(declared.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("uses"))


def unused(declared: DataFrame, used: DataFrame, key: str, ignored: Column) -> DataFrame:
    return declared.where(~ignored).join(used.select(key), key, "left_anti")


def outdated(declared: DataFrame, registry: DataFrame, key: str, version: str, latest: str) -> DataFrame:
    """Declared rows whose version differs from the latest one in the registry."""
    return declared.join(registry, key).where(F.col(version) != F.col(latest))


def count_findings(facts: DataFrame, key: str, finding: Column) -> DataFrame:
    """(key, findings) where there is at least one."""
    return facts.where(finding).groupBy(key).agg(F.count("*").alias("findings"))


def longest_prefix(items: DataFrame, path: str, prefixes: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """Each item with its longest prefix that ends at a separator: an equi-join on the item's ancestors instead of a theta join."""
    parts = F.split(path, F.lit(separator), -1)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    ancestors = items.withColumn(prefix, F.explode(up))
    return ancestors.join(prefixes.select(prefix).distinct(), prefix).groupBy(*items.columns).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


def segment_runs(items: DataFrame, path: str, run: str) -> DataFrame:
    """items with `run`, one row for every run of consecutive folders of the path, and `before`, how many folders stand before it. A folder at any depth is then found by an equi-join."""
    folders = F.filter(F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/"), lambda x: x != "")
    n = F.size(folders)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(i, F.greatest(n, i)), lambda j: F.struct((i - 1).alias("before"), F.array_join(F.slice(folders, i, j - i + 1), "/").alias("run")))))
    return items.withColumn("_r", F.explode(runs)).select(*items.columns, F.col("_r.before").alias("before"), F.col("_r.run").alias(run))


def folder_at_any_depth(items: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """Each item with the longest of the folders whose parts stand in its path one after the other; of equally long ones the first in the path."""
    hits = segment_runs(items, path, folder).join(folders.select(folder).distinct(), folder)
    return hits.groupBy(*items.columns).agg(F.max_by(folder, F.struct(F.length(folder), -F.col("before"), F.col(folder))).alias(folder))


def starts_with_join(items: DataFrame, value: str, prefixes: DataFrame, prefix: str, length: int) -> DataFrame:
    """Items joined to all prefixes of one length."""
    return items.withColumn(prefix, F.substring(value, 1, length)).join(prefixes.select(prefix).distinct(), prefix)


def inside_interval(points: DataFrame, spans: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """Points inside spans of the same key."""
    return points.join(spans, keys).where(F.col(point).between(F.col(low), F.col(high)))


def first_match(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def merged(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The distinct values of a key in order, joined by commas."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias(name))


def running_number(rows: DataFrame, keys: list[str], order: list[Column], counts: Column, name: str) -> DataFrame:
    """The number of counted rows up to each row of a key: line numbers of a diff."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(counts.cast("long")).over(w))
