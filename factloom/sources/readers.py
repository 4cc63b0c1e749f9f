"""Spark data sources for source trees and for diffs between revisions. Folders are listed inside tasks, ignored ones never.

`source_tree`: options root (a path or a URI that pyarrow knows), ignored (globs, one a line), prefix, splits. The driver's reader lists folders breadth first only until there are enough of
them to give every task its own; each task walks its folders from there. Filters on path (equal, in, starts with) narrow the folders that are entered; Spark hands them over where
spark.sql.python.filterPushdown.enabled is on.

`revision_diff`: options repository (in a folder that executors see), base, head. One list of changed names is read by the driver's reader; tasks make the diffs of their share of these.
"""

from __future__ import annotations

import re
import subprocess
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from factloom.functions.scalars import glob_regex

#: Folders to find before tasks take over, and files of a batch.
SPLITS, BATCH = 64, 64


def ignored_patterns(globs: list[str]) -> list[re.Pattern]:
    return [re.compile(glob_regex(g if g.startswith("**/") else "**/" + g)) for g in globs]


@dataclass
class Share(InputPartition):
    """Folders to walk, and folders of which only the files are taken."""

    deep: tuple[str, ...]
    flat: tuple[str, ...]


class TreeReader(DataSourceReader):
    def __init__(self, root: str, ignored: list[str], prefixes: list[str], splits: int):
        self.root, self.ignored, self.prefixes, self.splits = root.rstrip("/") or "/", ignored, prefixes, splits

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def _entered(self, folder: str, patterns: list[re.Pattern]) -> bool:
        """Whether anything below a folder may be wanted."""
        if any(p.match(f"{folder}/_") and p.match(f"{folder}/_/_") for p in patterns):
            return False
        return not self.prefixes or any(p.startswith(folder + "/") or f"{folder}/".startswith(p) for p in self.prefixes)

    def _list(self, store, base: str, folder: str, patterns: list[re.Pattern]) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders and files (path, bytes) directly in a folder, as far as they are wanted."""
        from pyarrow import fs

        folders, files = [], []
        for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
            path = f"{folder}/{x.base_name}" if folder else x.base_name
            if x.type == fs.FileType.Directory:
                if self._entered(path, patterns):
                    folders.append(path)
            elif x.type == fs.FileType.File and not any(p.match(path) for p in patterns) and (not self.prefixes or any(path.startswith(p) for p in self.prefixes)):
                files.append((path, x.size))
        return sorted(folders), sorted(files)

    def partitions(self):
        store, base = self._fs()
        patterns = ignored_patterns(self.ignored)
        waiting, flat = deque([""]), []
        while waiting and len(waiting) < self.splits and len(flat) < self.splits:
            folder = waiting.popleft()
            waiting.extend(self._list(store, base, folder, patterns)[0])
            flat.append(folder)
        return [Share((), tuple(flat)), *(Share((f,), ()) for f in waiting)]

    def read(self, partition: Share):
        store, base = self._fs()
        patterns = ignored_patterns(self.ignored)
        stack, rows = [(f, True) for f in partition.deep] + [(f, False) for f in partition.flat], []
        while stack:
            folder, deep = stack.pop()
            folders, files = self._list(store, base, folder, patterns)
            stack += [(f, True) for f in folders] if deep else []
            for path, size in files:
                with store.open_input_stream(f"{base}/{path}") as source:
                    rows.append((path, size, source.read().decode("utf-8", "replace")))
                if len(rows) >= BATCH or size > 1 << 24:
                    yield self._batch(rows)
                    rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "size_bytes", "content"])


class FilteredTreeReader(TreeReader):
    """For sessions that hand filters over; Spark refuses readers that take them in others."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                if isinstance(f, StringStartsWith):
                    self.prefixes = [p for p in self.prefixes if p.startswith(f.value)] or [f.value]
                elif isinstance(f, EqualTo):
                    self.prefixes = [f.value]
                elif isinstance(f, In):
                    self.prefixes = list(f.value)
            yield f  # Spark checks the rows once more


class SourceTree(DataSource):
    """(path, size_bytes, content) of the files below a root."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, size_bytes bigint, content string"

    def reader(self, schema):
        lines = lambda k: [x for x in self.options.get(k, "").split("\n") if x]
        kind = FilteredTreeReader if self.options.get("filters") == "true" else TreeReader
        return kind(self.options["root"], lines("ignored"), lines("prefix"), int(self.options.get("splits", SPLITS)))


@dataclass
class Changed(InputPartition):
    names: tuple[str, ...]


class RevisionReader(DataSourceReader):
    def __init__(self, repository: str, base: str, head: str):
        if base.startswith("-") or head.startswith("-"):
            raise ValueError("a revision cannot begin with a dash")
        self.repository, self.range = repository, f"{base}...{head}" if head else base

    def _git(self, *arguments: str) -> str:
        return subprocess.run(["git", "-C", self.repository, *arguments], capture_output=True, check=True).stdout.decode("utf-8", "replace")

    def partitions(self):
        names = [n for n in self._git("diff", "--name-only", "-z", "--no-renames", self.range, "--").split("\0") if n]
        return [Changed(tuple(names[i : i + BATCH])) for i in range(0, len(names), BATCH)] or [Changed(())]

    def read(self, partition: Changed):
        text = self._git("-c", "core.quotePath=false", "diff", "--no-color", "--no-renames", self.range, "--", *(f":(top,literal){n}" for n in partition.names)) if partition.names else ""
        blocks = re.split(r"(?m)^(?=diff --git )", text)
        yield from ((b,) for b in blocks if b)


class RevisionDiff(DataSource):
    """(text): the diff of each file that changed between two revisions."""

    @classmethod
    def name(cls):
        return "revision_diff"

    def schema(self):
        return "text string"

    def reader(self, schema):
        return RevisionReader(self.options["repository"], self.options["base"], self.options.get("head", "HEAD"))


def source_tree(spark, root: str, ignored: list[str] = (), prefix: str = ""):
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(root=root, ignored="\n".join(ignored), prefix=prefix, filters=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()


def revision_diff(spark, repository: str, base: str, head: str = "HEAD"):
    spark.dataSource.register(RevisionDiff)
    return spark.read.format("revision_diff").options(repository=repository, base=base, head=head).load()
