"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays of shards.

Two equal windows of `length` bytes have the same minimiser: the leftmost of their ANCHOR-byte strings with the least hash. So
every text is cut into stretches, the runs of windows with one minimiser; equal windows lie in stretches of equal minimisers,
and a shard needs those alone.
1. Each text gives its stretches: hash of the minimiser, hash of the stretch.
2. Minimisers that occur once hold no repeats. Stretches that occur twice or more are repeated as a whole.
3. Where a minimiser has stretches of several contents, each content is taken once. Whole minimisers are put together to
   shards, and a shard's suffix array (induced sorting) and its permuted common prefixes tell which windows repeat.
4. What repeats goes back to all texts that have the stretch.
A minimiser with very many contents, such as at the edge of a passage that many texts share, would make a shard of any size.
From CONTENTS on, its windows are compared by their 128-bit hashes and places instead, dealt out to all tasks: the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import discard, stored
from llm.near_dup import mixed
from llm.suffix_array import repeated

LENGTH = 400
#: Bytes of the strings among which minimisers are chosen: half a window, so that few minimisers repeat by chance.
ANCHOR = 200
CONTENTS = 2000
SHARD_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 1 << 22


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, inverse))


def stretches(data: bytes, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of at most _PIECE + length - 1 bytes: first and last window start, place of the minimiser, its hash, hash of
    the stretch."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    size = len(data) - anchor + 1
    power, inverse = _powers(1 << max(17, (len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = mixed((sums[anchor:] - sums[:-anchor]) * inverse[:size])
    span = length - anchor + 1
    keys = np.full(-(-size // span) * span, np.iinfo(np.uint64).max, np.uint64)
    keys[:size] = (hashes & ~_PLACE) | np.arange(size, dtype=np.uint64)
    blocks = keys.reshape(-1, span)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    place = (np.minimum(since[:windows], upto[span - 1 : span - 1 + windows]) & _PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.append(first[1:], windows) - 1
    place = place[first]
    whole = np.array([xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
    return first, last, place, hashes[place].view(np.int64), whole.view(np.int64)


def all_stretches(data: bytes, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Stretches of a text of any size; a very long one is cut into pieces of windows."""
    parts = []
    for start in range(0, max(1, len(data) - length + 1), _PIECE):
        first, last, place, *hashes = stretches(data[start : start + _PIECE + length - 1], length, anchor)
        parts.append((first + start, last + start, place + start, *hashes))
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _stretch_table(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """texts: key, row, text. Returns key, row and arrays of the stretches' values, for texts that have any."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [all_stretches(text.as_py().encode(), length, anchor) for text in batch.column(2)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(_lists(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["key", "row", "first", "last", "place", "mark", "whole"])

    return texts.select("key", "row", "text").mapInArrow(cut, "key string, row bigint, first array<int>, last array<int>, place array<int>, mark array<bigint>, whole array<bigint>").where(F.size("first") > 0)


def _each(table: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("mark", "whole", "first", "last", "place")
    return table.select("*", F.explode(zipped).alias("s")).select(*(c for c in table.columns if c in ("key", "row")), "s.*")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - 1


def _by_suffix_arrays(contents: DataFrame, length: int) -> DataFrame:
    """contents: mark, whole, content; whole minimisers come together. Returns mark, whole, low, high: runs of windows, by
    their place in the content, that start elsewhere in the shard too."""
    own = contents.repartition("mark").sortWithinPartitions("mark")

    def solved(shard: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        raw = b"".join(content + b"\0" for _, _, content in shard)
        text = np.frombuffer(raw, np.uint8).astype(np.uint16) + 2
        ends = np.cumsum([len(content) + 1 for _, _, content in shard]) - 1
        text[ends] = 1  # between contents
        flags = repeated(np.append(text, 0).astype(np.uint16), length)
        rows: list[tuple[int, int, int, int]] = []
        for (mark, whole, content), end in zip(shard, ends.tolist(), strict=True):
            low, high = _runs(flags[end - len(content) : end - length + 1])
            rows += [(mark, whole, a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["mark", "whole", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, size = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if group and group[-1][0] != row[0]:
                    shard += group
                    group = []
                    if size > SHARD_BYTES:
                        yield solved(shard)
                        shard, size = [], 0
                group.append(row)
                size += len(row[2])
        if shard or group:
            yield solved(shard + group)

    return own.mapInArrow(run, "mark bigint, whole bigint, low bigint, high bigint")


def _by_hashes(contents: DataFrame, length: int) -> DataFrame:
    """The same for minimisers with very many contents: contents has in addition `shift`, the minimiser's place in it. Equal
    windows have the minimiser at the same place."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                columns: list[list] = [[] for _ in range(6)]
                for mark, whole, content, shift in zip(*(batch.column(k).slice(start, 200).to_pylist() for k in range(4)), strict=True):
                    for low in range(len(content) - length + 1):
                        digest = xxhash.xxh3_128_digest(content[low : low + length])
                        for column, value in zip(columns, (mark, whole, low, shift - low, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["mark", "whole", "low", "shift", "a", "b"])

    each = contents.select("mark", "whole", "content", "shift").mapInArrow(windows, "mark bigint, whole bigint, low bigint, shift bigint, a bigint, b bigint")
    key = ["mark", "shift", "a", "b"]
    twice = each.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return each.join(twice, key).select("mark", "whole", "low", F.col("low").alias("high"))


def repeats(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """texts: key, row, text; rows of equal text have equal keys, and `row` tells them apart as well as may be. Returns key,
    starts: runs (first, last) of the starts of strings of `length` bytes that also start elsewhere, for the keys that have
    any."""
    table = stored(_stretch_table(texts, length, anchor), "stretches")
    by_content = _each(table.select("mark", "whole", "first", "last", "place")).groupBy("mark", "whole").agg(F.count("*").alias("n"))
    by_mark = by_content.groupBy("mark").agg(F.sum("n").alias("total"), F.count("*").alias("contents")).where("total > 1")
    several = stored(by_content.join(by_mark, "mark").select("mark", "whole", "n", "contents"), "several")
    # one row of each key speaks for all; it is chosen before its stretches move
    chosen = table.groupBy("key").agg(F.min("row").alias("row"))
    one = stored(table.join(chosen, ["key", "row"]).dropDuplicates(["key", "row"]), "single")
    each = _each(one)
    shared = stored(each.join(several, ["mark", "whole"]), "shared")

    contested = shared.where("contents > 1").groupBy("mark", "whole").agg(F.first("contents").alias("contents"), F.min(F.struct("key", "row", "first", "last", "place")).alias("of"))
    wanted = contested.groupBy("of.key", "of.row").agg(F.collect_list(F.struct("mark", "whole", "contents", "of.first", "of.last", "of.place")).alias("cuts"))
    sources = texts.join(stored(wanted, "wanted"), ["key", "row"]).dropDuplicates(["key", "row"]).select("text", "cuts")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, cuts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_py().encode()
                yield pa.RecordBatch.from_arrays([pa.array([c["mark"] for c in cuts], pa.int64()), pa.array([c["whole"] for c in cuts], pa.int64()),
                                                  pa.array([data[c["first"] : c["last"] + length] for c in cuts], pa.binary()),
                                                  pa.array([c["place"] - c["first"] for c in cuts], pa.int64()), pa.array([c["contents"] for c in cuts], pa.int64())], ["mark", "whole", "content", "shift", "contents"])

    contents = stored(sources.mapInArrow(take, "mark bigint, whole bigint, content binary, shift bigint, contents bigint"), "contents")
    parts = _by_suffix_arrays(contents.where(f"contents < {CONTENTS}").select("mark", "whole", "content"), length)
    parts = parts.union(_by_hashes(contents.where(f"contents >= {CONTENTS}"), length))

    full = shared.where("n > 1").select("key", F.struct("first", "last").alias("run"))
    some = shared.where("n = 1 and contents > 1").select("key", "mark", "whole", "first").join(parts, ["mark", "whole"])
    some = some.select("key", F.struct((F.col("first") + F.col("low")).cast("int").alias("first"), (F.col("first") + F.col("high")).cast("int").alias("last")).alias("run"))
    found = stored(full.union(some).groupBy("key").agg(F.collect_list("run").alias("starts")), "repeats")
    for done in (table, several, one, shared, contents):
        discard(done)
    return found


def remove(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs: doc_id, text; other columns are left aside. Returns a row for each row of docs: doc_id, n_bytes, kept (the bytes
    that no string of `length` bytes covers that also starts anywhere else), removed (the maximal runs taken out, as start and
    end in the text's bytes).

    Texts are UTF-8 bytes; a cut may fall inside a character. A null text is an empty one: nothing to keep. Texts shorter than
    `length` stay whole. Repeated rows repeat each other's strings, whatever their doc_id. An empty table gives no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.md5(text).alias("key"))
    found = repeats(own.select("key", F.xxhash64("doc_id").alias("row"), "text"), length, anchor)
    kind = dict(own.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, removed = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                if runs:
                    edges = np.array([(r["first"], r["last"] + length) for r in runs], np.int64)
                    np.add.at(change, edges[:, 0], 1)
                    np.add.at(change, edges[:, 1], -1)
                out = np.cumsum(change[:-1]) > 0
                first, last = _runs(out)
                sizes.append(len(data))
                kept.append(data[~out].tobytes())
                removed.append([{"start": a, "end": b + 1} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, spans)], ["doc_id", "n_bytes", "kept", "removed"])

    joined = own.join(found, "key", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")
