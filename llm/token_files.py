"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out in ranges of doc_id; each task encodes its range in order, appends the end id to every document, cuts
the one long run of ids into sequences, and writes pairs of Arrow IPC files: the sequences (ids and mask as fixed-size lists, so
that sequence k of a file is found by a multiplication and read from a memory map without a copy) and the documents (doc_id,
start of its ids in the file, their number). A file ends behind the document with which it has FILE_SEQUENCES sequences, so that
files stay small however much falls into a range. The rest of a file's last sequence is filled up and masked out. Files are
written and read batch by batch.

Files get a new name at each attempt; only those that the written manifest lists count. A lost executor or a repeated task
leaves at most files that nothing refers to. The manifest, a row per file, is one Parquet file, and a task of `read` takes several
files: a file system without native calls starts a process for each file that an executor makes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import partitions, stored
from llm.tokens import WORD_BPE, word_ids

SEQUENCE = 2048
END_ID = 1
SEQUENCES_A_BATCH = 256
FILE_SEQUENCES = 8192
#: Tokens of the files that a task of `read` takes, or fewer where cores would be idle.
TASK_TOKENS = 1 << 25
#: Code points by which rows of one doc_id are dealt out, in the order of their texts.
DEALT_BY = 64
MANIFEST = "part int, number int, path string, n_documents bigint, n_tokens bigint"


def at(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system that the address names, and the path there."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


class SequenceFile:
    """Writes runs of ids as batches of masked equal-length sequences."""

    def __init__(self, sink: pa.NativeFile, kind: np.dtype, length: int):
        self.kind, self.length, self.rest = kind, length, b""
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.uint8(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)

    def _put(self, raw: bytes, used: int) -> None:
        ids, mask = np.frombuffer(raw, self.kind), np.zeros(len(raw) // self.kind.itemsize, np.uint8)
        mask[:used] = 1
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def add(self, raw: bytes) -> None:
        raw, whole = self.rest + raw, self.length * self.kind.itemsize * SEQUENCES_A_BATCH
        full = len(raw) // whole * whole
        for start in range(0, full, whole):
            self._put(raw[start : start + whole], whole // self.kind.itemsize)
        self.rest = raw[full:]

    def close(self) -> None:
        if self.rest:
            size = self.length * self.kind.itemsize
            self._put(self.rest + bytes(-len(self.rest) % size), len(self.rest) // self.kind.itemsize)
        self.writer.close()


class FilePair:
    """A file of sequences and the file of its documents."""

    def __init__(self, folder: str, name: str, kind: np.dtype, sequence: int, id_type: pa.DataType):
        files, top = at(folder)
        files.create_dir(top)
        self.path, self.kind, self.n_documents, self.n_tokens = f"{folder.rstrip('/')}/{name}", kind, 0, 0
        self.sinks = [files.open_output_stream(f"{top}/{name}{ending}") for ending in ("", ".documents")]
        self.sequences = SequenceFile(self.sinks[0], kind, sequence)
        self.schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index = pa.ipc.new_file(self.sinks[1], self.schema)

    def add(self, ids: pa.Array, runs: list[bytes]) -> None:
        sizes = np.array([len(run) for run in runs], np.int64) // self.kind.itemsize
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.sequences.add(b"".join(runs))
        self.index.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(sizes)], schema=self.schema))
        self.n_documents += len(runs)
        self.n_tokens += int(sizes.sum())

    def close(self, part: int, number: int) -> pa.RecordBatch:
        """Returns the manifest's row."""
        self.sequences.close()
        self.index.close()
        for sink in self.sinks:
            sink.close()
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "path": [self.path], "n_documents": [self.n_documents], "n_tokens": [self.n_tokens]})


def _until(runs: list[bytes], size: int) -> int:
    """How many runs come to `size` bytes together; all, if they are fewer."""
    reached = 0
    for k, run in enumerate(runs, 1):
        reached += len(run)
        if reached >= size:
            return k
    return len(runs)


def write(docs: DataFrame, folder: str, tokenizer: str = WORD_BPE, sequence: int = SEQUENCE, end_id: int = END_ID, file_sequences: int = FILE_SEQUENCES) -> DataFrame:
    """docs: doc_id, text; other columns are left aside. Returns the manifest: part and number (in ascending order of doc_id),
    path, n_documents, n_tokens; the documents' file is path + ".documents".

    A null text is an empty one: the end id alone. Null doc_ids come first; rows of one doc_id follow each other by text. An
    empty table gives no files."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.repartitionByRange(partitions(spark), "doc_id", F.substring("text", 1, DEALT_BY)).sortWithinPartitions("doc_id", "text")
    path = at(folder)[1]
    at(folder)[0].create_dir(path)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, attempt, number, file = word_ids(tokenizer), TaskContext.get().partitionId(), uuid4().hex, 0, None
        end, full = np.array([end_id], words.kind).tobytes(), file_sequences * sequence * words.kind.itemsize
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                runs = [ids + end for ids in words.encode(batch.column(1).slice(begin, 500).to_pylist())]
                done = 0
                while done < len(runs):
                    file = file or FilePair(folder, f"{part:06}-{number:04}-{attempt}.arrow", words.kind, sequence, batch.schema.field(0).type)
                    some = runs[done : done + _until(runs[done:], full - file.n_tokens * words.kind.itemsize)]
                    file.add(batch.column(0).slice(begin + done, len(some)), some)
                    done += len(some)
                    if file.n_tokens * words.kind.itemsize >= full:
                        yield file.close(part, number)
                        file, number = None, number + 1
        if file:
            yield file.close(part, number)

    return stored(own.mapInArrow(written, MANIFEST).repartition(1), "manifest")


class Ids:
    """The ids of a file of sequences from its start on, batch by batch."""

    def __init__(self, sequences: pa.ipc.RecordBatchFileReader):
        self.sequences, self.number, self.rest = sequences, 0, np.zeros(0, np.uint16)

    def crc32(self, size: int) -> int:
        """Of the next `size` ids, as little-endian unsigned 32-bit integers."""
        crc = 0
        while size:
            if not len(self.rest):
                self.rest = self.sequences.get_batch(self.number).column("ids").flatten().to_numpy()
                self.number += 1
            crc = zlib.crc32(self.rest[:size].astype("<u4").tobytes(), crc)
            size, self.rest = size - min(size, len(self.rest)), self.rest[size:]
        return crc


def read(manifest: DataFrame, kind: str = "bigint", task_tokens: int = TASK_TOKENS) -> DataFrame:
    """kind: the type of doc_id; task_tokens: how many tokens a task takes, or fewer where cores would be idle. Returns a row for each
    document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned
    32-bit integers), path and first_sequence, the sequence of the file its ids begin in."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("start"))  # a row per file
    n_files, n_tokens = manifest.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-n_tokens // task_tokens))
    files = files.repartition(max(1, min(n_files, tasks)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                system, name = at(path)
                with system.open_input_file(name) as source, system.open_input_file(f"{name}.documents") as documents:
                    sequences, index = pa.ipc.open_file(source), pa.ipc.open_file(documents)
                    length, ids = sequences.schema.field("ids").type.list_size, Ids(sequences)
                    for k in range(index.num_record_batches):
                        rows = index.get_batch(k)
                        starts, sizes = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
                        yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "start": starts + first, "n_tokens": sizes, "ids_crc32": pa.array(map(ids.crc32, sizes.tolist()), pa.int64()),
                                                          "path": [path] * rows.num_rows, "first_sequence": starts // length})

    return files.mapInArrow(found, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, path string, first_sequence bigint")


def sequence_at(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a file, read where they lie: a view of the memory map for a local file."""
    system, name = at(path)
    source = pa.memory_map(name) if isinstance(system, pa.fs.LocalFileSystem) else system.open_input_file(name)
    batch = pa.ipc.open_file(source).get_batch(number // SEQUENCES_A_BATCH)
    inside = number % SEQUENCES_A_BATCH
    return tuple(batch.column(name).slice(inside, 1).flatten().to_numpy(zero_copy_only=True) for name in ("ids", "mask"))
