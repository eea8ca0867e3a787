"""Directory trees as a data source, with conditions that cut the listing.

    tree_source.scan(spark, "/mnt/shared/project", paths=["pkg/a.py"])
    tree_source.scan(spark, "s3://bucket/project", starts="src/", ends=(".py", ".pyi"), least=1, extensions=[".py", ".pyi"])

Conditions on ``path`` and ``size`` decide which folders are entered and which files are opened: one path
lists one chain of folders. They are options of the scan, not filters that Spark pushes: Spark 4.1 keeps
what was pushed into a Python source for later queries on the same DataFrame, which then lack rows.

While planning, at most ``planned`` folders are listed; the files found there are dealt out by size, and
every folder left is a partition, which a task walks. For a tree whose files mostly lie in few deep folders
``tree.read_tree`` deals the work out better, as files stay rows there.
"""

from __future__ import annotations

import json
import sys
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpusaudit.sources import tree

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, size bigint, content binary"
PLANNED = 64


@dataclass(frozen=True)
class Selection:
    """The conditions, all of which a file must meet: one of the paths (all, if None), how its path starts and one of the ways
    it ends, least and most bytes."""

    paths: frozenset[str] | None = None
    starts: str = ""
    ends: tuple[str, ...] = ("",)
    least: int = 0
    most: int = 1 << 62

    def enters(self, folder: str) -> bool:
        """Whether a path that meets the conditions may lie below a folder (relative to the root)."""
        below = f"{folder}/"
        return ((self.paths is None or any(path.startswith(below) for path in self.paths))
                and (self.starts.startswith(below) or below.startswith(self.starts)))

    def takes(self, path: str, size: int) -> bool:
        return ((self.paths is None or path in self.paths) and path.startswith(self.starts) and path.endswith(self.ends)
                and self.least <= size <= self.most)


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int]]


@dataclass
class Folder(InputPartition):
    path: str


class TreeReader(DataSourceReader):
    def __init__(self, address: str, wanted: tree.Wanted, selection: Selection = Selection(), with_content: bool = True,
                 planned: int = PLANNED, filesystem: pafs.FileSystem | None = None):
        self.address, self.wanted, self.selection, self.with_content = address, wanted, selection, with_content
        self.planned, self.filesystem, self.listed = planned, filesystem, 0

    def _list(self, files: pafs.FileSystem, folder: str, root: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders to enter and files to take of a folder."""
        self.listed += 1
        folders, found = [], []
        for entry in tree.entries(files, folder, self.wanted):
            path = tree.relative(entry.path, root)
            if entry.type == pafs.FileType.Directory:
                folders += [entry.path] if self.selection.enters(path) else []
            elif self.selection.takes(path, entry.size):
                found.append((entry.path, entry.size))
        return folders, found

    def partitions(self) -> list[InputPartition]:
        files, root = tree.opened(self.address, self.filesystem)
        top = files.get_file_info(root)
        if top.type != pafs.FileType.Directory:
            raise FileNotFoundError(f"Folder not found: {root}")
        waiting, parts, part, size = deque([root]), [], [], 0
        while waiting and self.listed < self.planned:
            folders, found = self._list(files, waiting.popleft(), root)
            waiting += folders
            for file in found:
                part.append(file)
                size += file[1]
                if size > tree.PARTITION_BYTES:
                    parts.append(Files(part))
                    part, size = [], 0
        return [*parts, *([Files(part)] if part else []), *map(Folder, waiting)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, root = tree.opened(self.address, self.filesystem)
        rows, size = [], 0
        for path, n in self._walk(files, root, partition):
            if self.with_content:
                if (found := tree.content(files, path)) is None:
                    continue
                size += len(found)
            rows.append((tree.relative(path, root), n, found) if self.with_content else (tree.relative(path, root), n))
            if size > tree.BATCH_BYTES or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, size = [], 0
        yield self._batch(rows)

    def _walk(self, files: pafs.FileSystem, root: str, partition: InputPartition) -> Iterator[tuple[str, int]]:
        if isinstance(partition, Files):
            yield from partition.found
            return
        waiting = [partition.path]
        while waiting:
            folders, found = self._list(files, waiting.pop(), root)
            waiting += folders
            yield from found

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())][: 3 if self.with_content else 2]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], [name for name, _ in kinds])


class TreeSource(DataSource):
    """Options: path, planned, and as JSON wanted (the arguments of ``tree.wanted_files``) and selection (those of
    ``Selection``). A schema of path and size alone opens no file."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        if schema.names not in (["path", "size"], ["path", "size", "content"]):
            raise ValueError(f"a tree has the columns {SCHEMA}, or the first two")
        given = json.loads(self.options.get("selection", "{}"))
        given |= {k: kind(given[k]) for k, kind in (("paths", frozenset), ("ends", tuple)) if given.get(k) is not None}
        wanted = tree.wanted_files(**json.loads(self.options.get("wanted", "{}")))
        return TreeReader(self.options["path"], wanted, Selection(**given), "content" in schema.names, int(self.options.get("planned", PLANNED)))


def scan(spark: SparkSession, address: str, paths: Iterable[str] | None = None, starts: str = "", ends: str | Iterable[str] = "", least: int = 0,
         most: int | None = None, content: bool = True, planned: int = PLANNED, **wanted) -> DataFrame:
    """``(path, size, content)`` of the files of a tree that meet the conditions, or ``(path, size)`` without opening them.

    paths, starts, ends: on the path below the tree's root; least, most: bytes; wanted: as in ``tree.read_tree``.
    """
    spark.dataSource.register(TreeSource)
    selection = {"paths": None if paths is None else sorted(paths), "starts": starts, "ends": [ends] if isinstance(ends, str) else sorted(ends),
                 "least": least} | ({} if most is None else {"most": most})
    reader = spark.read.format("tree").option("planned", planned).option("selection", json.dumps(selection)).option("wanted", json.dumps(wanted))
    return reader.schema(SCHEMA if content else SCHEMA.rpartition(",")[0]).load(address)
