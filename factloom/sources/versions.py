"""Tables that are published together: new data lies beside the old, and one small manifest, written last, makes all of it visible at once.

A folder holds `data/<id>/<table>` and `versions/<number>.json`. A writer puts its data down first, then its manifest under the next number; a manifest is renamed into place and never
replaced, so of two writers of one number the second fails and may try again on what is then the newest version. Readers take the highest number: they see a version
whole or not at all, and a reader of an older one is not disturbed until vacuum(). The file system must not replace a file on rename (HDFS and local ones do not).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """The published tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        """All versions, ascending."""
        at = self._path("versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: [folders]}, "notes": {...}} of a version, the newest one by default; empty before the first."""
        known = self.numbers()
        if version is None and not known:
            return {"tables": {}, "notes": {}}
        number = known[-1] if version is None else version
        if number not in known:
            raise ValueError(f"no version {number}; there are {known}")
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{number:012d}.json", wholetext=True).first()[0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        given = self.manifest(version)
        if name not in given["tables"]:
            raise KeyError(name)
        return self.spark.read.format(given["format"]).load([f"{self.folder}/{p}" for p in given["tables"][name]])

    def publish(self, tables: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None, notes: dict | None = None, fmt: str = "parquet", base: int | None = None) -> int:
        """Writes the tables (and what is appended to tables that exist), then makes all of it visible; gives the number. Tables not named stay as they are.
        base: the version that the tables were made from, if it must still be the newest."""
        known = self.numbers()
        newest = known[-1] if known else 0
        if base is not None and base != newest:
            raise RuntimeError(f"version {newest} has been published since {base}")
        old = self.manifest()
        folder = f"data/{uuid.uuid4().hex}"
        listed = dict(old["tables"])
        for name, df in tables.items():
            df.write.format(fmt).save(f"{self.folder}/{folder}/{name}")
            listed[name] = [f"{folder}/{name}"]
        for name, df in (appended or {}).items():
            df.write.format(fmt).save(f"{self.folder}/{folder}/{name}")
            listed[name] = [*old["tables"].get(name, []), f"{folder}/{name}"]
        self._put(newest + 1, {"format": fmt, "tables": listed, "notes": old["notes"] | (notes or {})})
        return newest + 1

    def _put(self, number: int, content: dict) -> None:
        at, draft = self._path(f"versions/{number:012d}.json"), self._path(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(at), none)
        except Exception as error:
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {number} has been published by someone else") from error

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the newest versions, and data that no kept version names. Not while others write or read older versions."""
        known = self.numbers()
        kept = known[-max(1, keep) :]
        used = {p.split("/")[1] for n in kept for paths in self.manifest(n)["tables"].values() for p in paths}
        for n in known[: len(known) - len(kept)]:
            self._fs.delete(self._path(f"versions/{n:012d}.json"), False)
        if self._fs.exists(self._path("data")):
            for s in self._fs.listStatus(self._path("data")):
                if s.getPath().getName() not in used:
                    self._fs.delete(s.getPath(), True)
