"""Allow and block rules for URLs, looked up in a sorted array of digests.

A rule is a host, which stands for itself and all its subdomains, and the beginning of a path. Rules are sorted by the 64-bit
xxHash of host and path and written to Arrow files of at most FILE_ENTRIES entries, which tasks map into memory: pages of a
file are read when a search comes to them and are shared by a machine's workers, so that a list of any length costs a worker
no memory of its own. Besides the rules, the array holds an entry for each host with the lengths of its rules' paths. A batch
of URLs is looked up by two binary searches over all of its candidates at once: which of the endings of its hosts have rules,
then which beginnings of its paths, of the lengths named there, are rules. What a digest finds counts only if the text stored
with it is the candidate's.

The list of files (a row for every FILE_ENTRIES entries or task that wrote) is all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import partitions, stored
from llm.token_files import at

ALLOW, BLOCK = "allow", "block"
FILE_ENTRIES = 1 << 20
#: The seed of Spark's xxhash64, so that both sides agree.
SEED = 42
#: Before a host in the text of its own entry; no host of a rule begins like this.
OF_HOST = "//"
ENTRY = pa.schema([("key", pa.int64()), ("text", pa.large_string()), ("verdict", pa.string()), ("lengths", pa.large_list(pa.int32()))])
FILES = "path string, first bigint, last bigint, n bigint"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [k for mark in "?#" if (k := rest.find(mark)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.lower() if host.isascii() else "".join(c.lower() if c.isascii() else c for c in host), slash + path


def write_rules(rules: DataFrame, folder: str) -> DataFrame:
    """rules: host (in lower case, without / ? #), path (empty, or the beginning of paths), verdict (allow or block); other
    columns are left aside. Writes the sorted array and returns its files.

    Rules without a host or a verdict are left out, a null path is an empty one. Of two rules for one host and path, block
    holds. An empty table gives an array without entries."""
    spark = rules.sparkSession
    own = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null")
    one = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = one.groupBy("host").agg(F.array_sort(F.collect_set(F.char_length("path"))).alias("lengths"))
    entries = one.select(F.concat("host", "path").alias("text"), "verdict", F.lit(None).cast("array<int>").alias("lengths"))
    entries = entries.unionByName(hosts.select(F.concat(F.lit(OF_HOST), F.col("host")).alias("text"), F.lit(None).cast("string").alias("verdict"), "lengths"))
    keyed = entries.select(F.xxhash64("text").alias("key"), "text", "verdict", "lengths").repartitionByRange(partitions(spark), "key").sortWithinPartitions("key", "text")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = at(folder)
        files.create_dir(top)
        waiting: list[pa.RecordBatch] = []

        def put() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).cast(ENTRY).combine_chunks()
            waiting.clear()
            name = f"{uuid4().hex}.arrow"
            with files.open_output_stream(f"{top}/{name}") as sink, pa.ipc.new_file(sink, ENTRY) as file:
                file.write_batch(table.to_batches()[0])
            keys = table.column("key")
            return pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "first": [keys[0].as_py()], "last": [keys[-1].as_py()], "n": [len(keys)]})

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, FILE_ENTRIES - sum(b.num_rows for b in waiting))
                waiting.append(part)
                start += part.num_rows
                if sum(b.num_rows for b in waiting) == FILE_ENTRIES:
                    yield put()
        if waiting:
            yield put()

    return stored(keyed.mapInArrow(written, FILES), "rule_files")


class DigestArray:
    """The files of a sorted array, opened when a search comes to them."""

    def __init__(self, files: Sequence[tuple[str, int, int]]):
        self.files = sorted(files, key=lambda file: file[1:])
        self.first, self.last = (np.array([file[k] for file in self.files], np.int64) for k in (1, 2))

    @staticmethod
    @lru_cache(maxsize=64)
    def _open(path: str) -> tuple[np.ndarray, pa.RecordBatch]:
        system, name = at(path)
        source = pa.memory_map(name) if isinstance(system, pa.fs.LocalFileSystem) else system.open_input_file(name)
        entries = pa.ipc.open_file(source).get_batch(0)
        return entries.column("key").to_numpy(zero_copy_only=True), entries

    def find(self, texts: Sequence[str], column: str) -> list:
        """For each text its entry's value in a column; None without an entry."""
        found: list = [None] * len(texts)
        if not self.files or not texts:
            return found
        keys = np.fromiter((xxhash.xxh64_intdigest(text, SEED) for text in texts), np.uint64, len(texts)).view(np.int64)
        low, high = np.searchsorted(self.last, keys, "left"), np.searchsorted(self.first, keys, "right")
        for number in np.unique(np.concatenate([low, high - 1])).tolist():
            inside = np.flatnonzero((low <= number) & (number < high))
            if len(inside):
                own, entries = self._open(self.files[number][0])
                begin, end = np.searchsorted(own, keys[inside], "left"), np.searchsorted(own, keys[inside], "right")
                stored_texts, values = entries.column("text"), entries.column(column)
                for at_text, a, b in zip(inside[hit := begin < end].tolist(), begin[hit].tolist(), end[hit].tolist(), strict=True):
                    for place in range(a, b):  # more than one only where digests collide
                        if stored_texts[place].as_py() == texts[at_text]:
                            found[at_text] = values[place].as_py()
        return found


def endings(host: str) -> list[str]:
    """The host and the hosts it is a subdomain of, longest first."""
    found = [host] if host else []
    while "." in host:
        host = host.partition(".")[2]
        if host:
            found.append(host)
    return found


def verdicts(array: DigestArray, urls: Sequence[tuple[str, str]], default: str = ALLOW) -> list[tuple[str | None, str]]:
    """For each host and path the longest rule that fits (of equally long ones that with the longer host) and its verdict."""
    by_host = {host: endings(host) for host in {host for host, _ in urls}}
    candidates = list(dict.fromkeys(chain.from_iterable(by_host.values())))
    lengths = {host: found for host, found in zip(candidates, array.find([OF_HOST + host for host in candidates], "lengths"), strict=True) if found}
    tries: dict[str, str | None] = {}
    each = []
    for host, path in urls:
        own = [(len(ending) + n, len(ending), ending + path[:n]) for ending in by_host[host] for n in lengths.get(ending, ()) if n <= len(path)]
        own.sort(reverse=True)
        each.append([text for _, _, text in own])
        tries.update(dict.fromkeys(each[-1]))
    tries = dict(zip(tries, array.find(list(tries), "verdict"), strict=True))
    fitting = (next((text for text in own if tries[text] is not None), None) for own in each)
    return [(rule, tries[rule] if rule is not None else default) for rule in fitting]


def judge(pages: DataFrame, rules: DataFrame, keys: Sequence[str] = ("page_id",), default: str = ALLOW) -> DataFrame:
    """pages: `keys` and url; other columns are left aside. rules: the files of write_rules. Returns for each row its keys,
    host, path, rule (host and path of the longest rule that fits; null if none) and verdict (the rule's, else `default`).

    A null or empty url, or one without ://, has an empty host and path and fits no rule. Repeated rows each get a row; an
    empty table gives none."""
    files = [(r["path"], r["first"], r["last"]) for r in rules.select("path", "first", "last").collect()]
    own = pages.select(*keys, F.col("url").cast("string").alias("url"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(files)
        for batch in batches:
            urls = [split_url(url) for url in batch.column(len(keys)).to_pylist()]
            found = verdicts(array, urls, default)
            columns = [pa.array(column, pa.string()) for column in zip(*((*url, *verdict) for url, verdict in zip(urls, found, strict=True)), strict=True)] or [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], [*keys, "host", "path", "rule", "verdict"])

    kinds = dict(own.dtypes)
    return own.mapInArrow(judged, ", ".join([*(f"`{key}` {kinds[key]}" for key in keys), "host string, path string, rule string, verdict string"]))
