"""A Spark sink that writes one text file a row, under the row's own name. Tasks write drafts; the files get their names when all tasks are done, and drafts of a failed job are deleted."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Drafts(WriterCommitMessage):
    """(draft, name) of the files of one task."""

    files: tuple[tuple[str, str], ...]


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def write(self, rows):
        store, base = self._fs()
        made = []
        for row in rows:
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a file name below the folder: {name!r}")
            draft = f"{base}/_drafts-{self.job}/{uuid.uuid4().hex}"
            store.create_dir(draft.rpartition("/")[0])
            with store.open_output_stream(draft) as out:
                out.write((row["text"] or "").encode())
            made.append((draft, f"{base}/{name}"))
        return Drafts(tuple(made))

    def commit(self, messages):
        store, base = self._fs()
        for m in messages:
            for draft, name in m.files if m else ():
                store.create_dir(name.rpartition("/")[0])
                store.move(draft, name)
        self._clear(store, base)

    def abort(self, messages):
        self._clear(*self._fs())

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/_drafts-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_drafts-{self.job}")


class NamedFiles(DataSource):
    """Rows (name, text) as files below the option folder."""

    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return "name string, text string"

    def writer(self, schema, overwrite):
        return FileWriter(self.options["folder"])


def write_named_files(rows: DataFrame, folder: str) -> None:
    """rows (name, text): one file each below folder; a file of the same name is replaced. Names that stand twice are an error before anything is written."""
    twice = rows.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two texts for one name: {twice[0].name}")
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "text").write.format("named_files").option("folder", folder).mode("append").save()
