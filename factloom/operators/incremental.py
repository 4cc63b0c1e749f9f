"""Facts that are kept between runs: files are parsed once for each content, and specifiers are resolved again only where the files they may mean have come or gone.

What a parse gives depends on a file's text and on whether tags may stand in it, so it is kept under a hash of both: an update reads the files whose hash is new, once for each hash,
and a file that is moved or copied costs nothing. Resolution depends on which candidates exist: the candidates of every specifier are kept, and files that were added or removed meet them in
an equi-join. All tables of a state become visible together (sources/versions.py); an update that fails leaves the state before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.analyzers import Facts
from factloom.sources import code_facts, names
from factloom.sources.versions import Versions
from factloom.tables import durable

#: What is kept for each content.
PARSED = ("nodes", "plain", "names")


def _keyed(files: DataFrame) -> DataFrame:
    """Code files with key: a hash of the content, ending as the parser needs to see it."""
    kind = F.when(F.col("path").endswith(".ts"), ".ts").otherwise(".tsx")
    return code_facts.code_files(files).withColumn("key", F.concat(F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256), kind))


class IncrementalFacts(Facts):
    """Facts over a store. parsed and resolved tell how many contents were read and how many specifiers were looked up by this update."""

    def __init__(self, files: DataFrame, aliases: DataFrame, folder: str):
        super().__init__(files, aliases)
        self.store = Versions(files.sparkSession, folder)
        self._kept = {}
        self._parse()
        self._resolve()

    def _parse(self) -> None:
        keyed = durable(_keyed(self._files), "keyed-files")
        known = self.store.manifest()["tables"]
        fresh = keyed.select("key", "content").dropDuplicates(["key"])
        if "contents" in known:
            fresh = fresh.join(self.store.table("contents").select("key"), "key", "left_anti")
        fresh = durable(fresh.withColumnRenamed("key", "path"), "fresh-contents")
        self.parsed = fresh.count()
        if self.parsed or "contents" not in known:
            made = {"nodes": code_facts.nodes, "plain": code_facts.plain, "names": names.names}
            rows = {name: make(fresh).withColumnRenamed("path", "key") for name, make in made.items()}
            self.store.publish({}, appended=rows | {"contents": fresh.select(F.col("path").alias("key"))})
        self._kept["keyed"] = keyed.select("path", "key")

    def _parsed_rows(self, name: str) -> DataFrame:
        """A kept table's rows for the files of today."""
        rows = self.store.table(name)
        return rows.join(self._kept["keyed"], "key").select("path", *[c for c in rows.columns if c != "key"])

    def _resolve(self) -> None:
        paths, known = self._files.select("path").distinct(), self.store.manifest()
        wanted = code_facts.imports(self["plain"]).select("path", "specifier").union(code_facts.re_exports(self["plain"]).select("path", "specifier")).distinct()
        wanted = durable(wanted, "wanted")
        hashes = self._aliases.select(F.xxhash64(*self._aliases.columns).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")), F.count("*"))
        aliases = str(tuple(map(str, hashes.first())))
        old = known["tables"]
        if "resolved" in old and known["notes"].get("aliases") == aliases:
            before = self.store.table("paths")
            changed = paths.join(before, "path", "left_anti").union(before.join(paths, "path", "left_anti"))
            touched = self.store.table("candidates").join(changed.withColumnRenamed("path", "src_path"), "src_path", "left_semi").select("path", "specifier").distinct()
            done = self.store.table("specifiers").join(touched, ["path", "specifier"], "left_anti").join(wanted, ["path", "specifier"], "left_semi")
        else:
            done = wanted.limit(0)
        done = durable(done, "still-resolved")
        todo = durable(wanted.join(done, ["path", "specifier"], "left_anti"), "to-resolve")
        self.resolved = todo.count()
        tried = durable(code_facts.candidates(todo, self._aliases), "candidates")
        found = code_facts.first_existing(tried, paths)
        if "resolved" in old:
            tried = self.store.table("candidates").join(done, ["path", "specifier"], "left_semi").unionByName(tried)
            found = self.store.table("resolved").join(done, ["path", "specifier"], "left_semi").unionByName(found)
        self.version = self.store.publish({"paths": paths, "specifiers": wanted, "candidates": tried, "resolved": found}, notes={"aliases": aliases})

    def _build(self, name: str) -> DataFrame:
        if name in PARSED:
            return self._parsed_rows(name)
        if name in ("imports", "re_exports"):
            rows = getattr(code_facts, name)(self["plain"])
            return code_facts.with_sources(rows, self.store.table("resolved"))
        return super()._build(name)
