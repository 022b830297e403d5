"""Folders of small files as a data source: listed and read on executors, filtered before a file is opened, written a file a row.

Spark's own file sources pass over names that begin with a dot or an underscore, which
package files, ignore files and settings do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

#: Session setting with which Spark hands filters to sources written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
LISTINGS = 16


def file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/") or "/")


@dataclass
class Listing(InputPartition):
    """A folder, with all below it or its own files alone, of which the part with this remainder of a name's hash is read."""

    folder: str
    deep: bool
    remainder: int
    parts: int


_COMPARE = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
    IsNotNull: lambda a, b: True,
}


def known_before_reading(f: Filter) -> bool:
    """Whether a filter asks for the path or the size alone."""
    if isinstance(f, Not):
        return known_before_reading(f.child)
    return type(f) in _COMPARE and f.attribute in (("path",), ("size_bytes",))


def passes(f: Filter, path: str, size: int) -> bool:
    if isinstance(f, Not):
        return not passes(f.child, path, size)
    return _COMPARE[type(f)](path if f.attribute == ("path",) else size, getattr(f, "value", None))


class RepositoryFiles(DataSource):
    """``spark.read.format("repository_files").option("path", root)``: (path, size_bytes, content) of all files below a folder.

    Options: folders named in ``prune`` (comma-joined) are not entered; files over
    ``most`` bytes have no content; ``listings`` is the number of listings that are
    dealt out at least, where there are as many folders or files.  With ``push``, for
    sessions that set PUSHDOWN, files that a filter on path or size leaves out are not
    opened.  Written rows (name, content) become one file each; see ``_FilesWriter``.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return "path string, size_bytes long, content binary"

    def reader(self, schema) -> DataSourceReader:
        prune = self.options.get("prune", "")
        kind = _PushedFilesReader if self.options.get("push", "false") == "true" else _FilesReader
        return kind(self.options["path"], set(filter(None, prune.split(","))), int(self.options.get("most", -1)), int(self.options.get("listings", LISTINGS)))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _FilesWriter(self.options["path"])


class _FilesReader(DataSourceReader):
    def __init__(self, root: str, prune: set[str], most: int, listings: int):
        self.root, self.prune, self.most, self.listings = root, prune, most, listings
        self.filters: list[Filter] = []

    def partitions(self) -> list[InputPartition]:
        """Folders near the root, level by level until there are enough; what lies in them is listed where it is read.

        With fewer folders each is dealt to several tasks by a hash of the names.
        """
        from pyarrow import fs

        system, base = file_system(self.root)
        own, level = [], [base]
        while level and len(own) + len(level) < self.listings:
            below = [info.path for folder in level for info in system.get_file_info(fs.FileSelector(folder)) if info.type == fs.FileType.Directory and info.base_name not in self.prune]
            own += level
            level = sorted(below)
        folders = [(folder, False) for folder in own] + [(folder, True) for folder in level]
        parts = -(-self.listings // len(folders))
        return [Listing(folder, deep, k, parts) for folder, deep in folders for k in range(parts)]

    def _listed(self, listing: Listing) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        system, base = file_system(self.root)
        folders = [listing.folder]
        while folders:
            inner = []
            for info in sorted(system.get_file_info(fs.FileSelector(folders.pop())), key=lambda i: i.path):
                if info.type == fs.FileType.File:
                    if zlib.crc32(info.path.encode()) % listing.parts == listing.remainder:
                        yield info.path, info.size
                elif info.type == fs.FileType.Directory and listing.deep and info.base_name not in self.prune:
                    inner.append(info.path)
            folders += reversed(inner)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, base = file_system(self.root)
        start = len(base.rstrip("/")) + 1
        for path, size in self._listed(partition):
            if all(passes(f, path[start:], size) for f in self.filters):
                content = None
                if self.most < 0 or size <= self.most:
                    with system.open_input_stream(path) as f:
                        content = f.read()
                yield path[start:], size, content


class _PushedFilesReader(_FilesReader):
    """A reader of its own, as Spark refuses one that takes filters where the session does not hand them over."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if known_before_reading(f):
                self.filters.append(f)
            else:
                yield f


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class _FilesWriter(DataSourceWriter):
    """Rows (name, content) as files of a folder, put in place when all tasks are done.

    Each task writes below a hidden folder of the job; commit moves what finished
    tasks wrote, of equal names any one, and removes the hidden folder with all that
    retried or failed tasks left; abort removes it and leaves the folder as it was.
    """

    def __init__(self, root: str):
        self.root, self.job = root, f".staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, base = file_system(self.root)
        folder = f"{base}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        for r in rows:
            if not r["name"] or "/" in r["name"] or r["name"] in (".", ".."):
                raise ValueError(f"not a file name: {r['name']!r}")
            with system.open_output_stream(f"{folder}/{r['name']}") as out:
                out.write(bytes(r["content"]))
        return Staged(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, base = file_system(self.root)
        system.create_dir(base, recursive=True)
        for m in filter(None, messages):
            for info in system.get_file_info(fs.FileSelector(m.folder)):
                system.move(info.path, f"{base}/{info.base_name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, base = file_system(self.root)
        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")
