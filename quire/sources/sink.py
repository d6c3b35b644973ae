"""Files written from pieces: a data source whose tasks append the pieces of each file; the commit gives them their names."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def _name(path: str) -> str:
    """A path below the folder: without a scheme, a leading slash or steps upwards."""
    plain = posixpath.normpath(path.split(":", 1)[1] if ":" in path.split("/")[0] else path)
    return "/".join(p for p in plain.split("/") if p not in ("", ".", ".."))


@dataclass
class Saved(WriterCommitMessage):
    """Names in the staging folder, and in the end: of files, or of the one folder with all that a task wrote."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, folders: bool = False) -> None:
        self.folder, self.folders, self.staging = folder, folders, f".saving-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Saved:
        """Rows (path, offset, data) of whole files, one file after another, into the staging folder under names of their own, so that a
        task that runs again disturbs nothing."""
        store, root = _store(self.folder)
        root, own = f"{root.rstrip('/')}/{self.staging}", uuid.uuid4().hex
        if self.folders:
            root = f"{root}/{own}"
        store.create_dir(root)
        now, out, files, made = None, None, [], {""}
        for path, _, data in rows:
            if path != now:
                if out:
                    out.close()
                now = path
                name = _name(path) if self.folders else uuid.uuid4().hex
                if self.folders and (parent := posixpath.dirname(name)) not in made:
                    store.create_dir(f"{root}/{parent}")
                    made.add(parent)
                if not self.folders:
                    files.append((name, _name(path)))
                out = store.open_output_stream(f"{root}/{name}")
            out.write(bytes(data))
        if out:
            out.close()
        return Saved([(own, own)] if self.folders and now is not None else files)

    def commit(self, messages: list[Saved | None]) -> None:
        """Give the files of tasks that succeeded their names; nothing is seen of a job that fails."""
        store, root = _store(self.folder)
        root = root.rstrip("/")
        folders = set()
        for part, name in (f for m in messages if m for f in m.files):
            parent = posixpath.dirname(f"{root}/{name}")
            if parent not in folders:
                store.create_dir(parent)
                folders.add(parent)
            store.move(f"{root}/{self.staging}/{part}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Saved | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.folder)
        staging = f"{root.rstrip('/')}/{self.staging}"
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class Files(DataSource):
    """Format "pieces": the option path is a folder of a store that pyarrow reaches; folders gives each task's files a folder of their own."""

    @classmethod
    def name(cls) -> str:
        return "pieces"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("folders", "false").lower() == "true")


def save(pieces: DataFrame, folder: str, folders: bool = False) -> None:
    """Write files from pieces (path, offset, data; see writer.parts) into a folder that all executors reach; paths with folders keep them below it.

    folders: for very many files. Each task's files come into a folder of their own, which the commit names whole, so that neither their
    names nor their renaming go through the driver; a file saved before under the same path stays beside the new one.
    """
    pieces.sparkSession.dataSource.register(Files)
    rows = pieces.select("path", "offset", "data").repartition("path").sortWithinPartitions("path", "offset")
    rows.write.format("pieces").option("path", folder).option("folders", str(folders).lower()).mode("append").save()
