"""Directory trees as corpora, listed and read by the tasks.

Spark's own file readers drop every file whose name starts with ``_`` or ``.``, which a source tree
cannot do without (``__init__.py``). Here folders are rows: each level of the tree is one pass in which
tasks list the folders of the level before, prune directories, and test extension, size and excluded
substrings on metadata alone. The files stay rows as well, are dealt out to about one task per
``partition_bytes``, and read there; the driver holds no path but the root. Trees are opened by address
through ``pyarrow.fs``: a mounted folder, or any storage that it knows.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import text
from corpusaudit.sinks import writers

# The functions travel with the job, so executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTITION_BYTES = 32 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class Wanted:
    """What a scan takes of a tree."""

    extensions: frozenset[str]
    skip_dirs: frozenset[str]
    exclude: tuple[str, ...]
    max_size: int

    def takes(self, file: pafs.FileInfo) -> bool:
        slashed = file.path.replace("\\", "/")
        return (os.path.splitext(file.path)[1].lower() in self.extensions and not any(part in slashed for part in self.exclude)
                and file.size <= self.max_size)

    def enters(self, folder: pafs.FileInfo, local: bool) -> bool:
        return folder.base_name not in self.skip_dirs and folder.base_name[0] != "." and not (local and os.path.islink(folder.path))


def opened(address: str, filesystem: pafs.FileSystem | None = None) -> tuple[pafs.FileSystem, str]:
    """The file system that holds an address, and the path there. A plain path is one of this machine's."""
    if filesystem is not None:
        return filesystem, address.rstrip("/") or "/"
    files, path = pafs.FileSystem.from_uri(address if "://" in address else os.path.abspath(address))
    return files, path.rstrip("/") or "/"


def entries(files: pafs.FileSystem, folder: str, wanted: Wanted) -> Iterator[pafs.FileInfo]:
    """The wanted files of a folder and the folders in it that are to be entered; nothing if it cannot be listed."""
    try:
        found = files.get_file_info(pafs.FileSelector(folder))
    except OSError:
        return
    local = isinstance(files, pafs.LocalFileSystem)
    for entry in found:
        if entry.type == pafs.FileType.Directory and wanted.enters(entry, local) or entry.type == pafs.FileType.File and wanted.takes(entry):
            yield entry


def content(files: pafs.FileSystem, path: str) -> bytes | None:
    """A file's bytes; None if it cannot be read."""
    try:
        with files.open_input_stream(path) as stream:
            return stream.read()
    except OSError:
        return None


def _listed(files: pafs.FileSystem, wanted: Wanted):
    """Folders to their entries: ``(path, size)``, with no size for folders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [(e.path, None if e.type == pafs.FileType.Directory else e.size) for e in entries(files, folder, wanted)]
                columns = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64()))], ["path", "size"])
    return run


def _contents(files: pafs.FileSystem, root: str):
    """Files to ``(path relative to the root, content)``; those that cannot be read are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents, size = [], [], 0
            for full in batch.column(0).to_pylist():
                if (found := content(files, full)) is None:
                    continue
                contents.append(found)
                paths.append(relative(full, root))
                size += len(found)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
    return run


def relative(full: str, root: str) -> str:
    """The part of a path below the root; some file systems give paths without the slash before them."""
    full, root = full.strip("/"), root.strip("/")
    return full[len(root) + 1 if root else 0:].replace("\\", "/")


def list_tree(spark: SparkSession, files: pafs.FileSystem, root: str, wanted: Wanted) -> DataFrame:
    """``(path, size)`` of the wanted files under a folder, level by level."""
    level, found = spark.createDataFrame([(root,)], "path string"), None
    while level.head(1):
        listed = writers.checkpointed(level.mapInArrow(_listed(files, wanted), "path string, size bigint"))
        own = listed.where("size IS NOT NULL")
        found = own if found is None else found.unionByName(own)
        level = listed.where("size IS NULL").select("path").repartition(spark.sparkContext.defaultParallelism)
    return found


def wanted_files(extensions=None, skip_dirs=None, max_size: int | None = None, exclude_patterns=None) -> Wanted:
    return Wanted(frozenset(extensions or dims.SCAN_EXTENSIONS), frozenset(skip_dirs or dims.SKIP_DIRS),
                  tuple(exclude_patterns or ()), dims.MAX_FILE_SIZE if max_size is None else max_size)


def read_tree(spark: SparkSession, path: str, extensions=None, skip_dirs=None, max_size: int | None = None,
              exclude_patterns=None, partition_bytes: int = PARTITION_BYTES, filesystem: pafs.FileSystem | None = None) -> DataFrame:
    """``(path, content)`` text files of a directory tree (or of one file), by path or address, or in a given file system."""
    files, root = opened(path, filesystem)
    top = files.get_file_info(root)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"Path not found: {root}")
    wanted = wanted_files(extensions, skip_dirs, max_size, exclude_patterns)
    if top.type == pafs.FileType.File:
        listed = spark.createDataFrame([(root, top.size)] if wanted.takes(top) else [], "path string, size bigint")
        root = root.rpartition("/")[0]
    else:
        listed = list_tree(spark, files, root, wanted)
    n_files, n_bytes = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, min(n_files, -(-n_bytes // partition_bytes)))
    raw = listed.select("path").repartition(parts).mapInArrow(_contents(files, root), "path string, content binary")
    return raw.selectExpr("path", f"{text.decode('content')} AS content")
