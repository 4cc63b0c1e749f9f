"""Manifests of components: JSON to rows, checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENTRY = "map<string, struct<type string, path string>>"


def manifest(texts: DataFrame) -> DataFrame:
    """(name, type, path, listed) of manifest texts (content): entries of `components` and `functions`, listed telling which; paths lose `./` and a closing slash."""
    j = texts.select(F.from_json("content", f"components {_ENTRY}, functions {_ENTRY}").alias("j"))
    rows = None
    for group, kind in (("components", "component"), ("functions", "functions")):
        one = j.select(F.explode(F.col(f"j.{group}")).alias("name", "e")).select("name", F.coalesce("e.type", F.lit(kind)).alias("type"), F.regexp_replace(F.regexp_replace("e.path", r"^\./", ""), r"/+$", "").alias("path"), F.lit(kind).alias("listed"))
        rows = one if rows is None else rows.union(one)
    return rows


def problems(manifest_rows: DataFrame) -> DataFrame:
    """(name, problem): entries without a name or path, of a type other than their list's, and names that stand twice."""
    empty = manifest_rows.where("path is null or path = ''").select("name", F.lit("no path").alias("problem"))
    nameless = manifest_rows.where("trim(name) = ''").select("name", F.lit("no name").alias("problem"))
    twice = manifest_rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("not unique").alias("problem"))
    other = manifest_rows.where("type <> listed").select("name", F.lit("wrong type").alias("problem"))
    return empty.union(nameless).union(twice).union(other)


def components(manifest_rows: DataFrame) -> DataFrame:
    """(name, root) for the component analyzers."""
    return manifest_rows.where("type = 'component'").select("name", F.col("path").alias("root"))
