"""Duplicate blocks: every run of ``min_lines`` normalised lines, hashed and grouped.

A corpus is normalised and hashed once, and stored as one row per file with the line and 16-byte key of
each of its blocks (``Blocks``). Everything else starts from there:

* Paths are numbered in their order by a range sort of short rows. A place is then one long, file number
  and line, and the first place of a group is the least long: the groups come from one hash aggregate
  with buffers of fixed width, folded before the shuffle. A block that stands in a third of all files is
  one row per map task there.
* Places of given groups are sought behind a bit filter of their keys, made of them in parallel and of
  bounded size, so that blocks that occur once don't reach the shuffle. Places are never collected: they
  stay rows, joined to the groups by key; a key that holds a large share of them is left to Spark's skew
  join, which splits it by map output. Where the caller allows it, few keys go to all tasks as they are,
  and no place is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.functions import text
from corpusaudit.sinks import scratch

MIN_LINES = 5
# fixed values: normalised lines that carry no information
NOISE_LINES = ["", "{", "}", "else:", "pass"]

TOP_GROUPS = 20

# Words of 64 bits of the filter of keys: about 20 bits for each key, up to FILTER_WORDS (some 40 MB in memory) in all.
BITS_A_KEY, FILTER_WORDS = 20, 1 << 20

# Keys of 16 bytes that a report broadcasts as they are (some 20 MB in memory).
KEYS_SENT = 1 << 17


def windows(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``(path, start_line, block)`` for every run of lines; files that are too short give none."""
    rows = files.selectExpr("path", f"{text.split_lines(text.normalize('content'))} AS normal")
    # The length test stands inside the generator: as a filter it would be pushed down and normalise twice.
    starts = f"IF(size(normal) >= {min_lines}, sequence(1, size(normal) - {min_lines - 1}), CAST(array() AS ARRAY<INT>))"
    rows = rows.selectExpr("path", "normal", f"explode({starts}) AS start_line")
    return rows.select("path", "start_line", F.slice("normal", F.col("start_line"), min_lines).alias("block"))


def is_informative(block: str, min_lines: int = MIN_LINES) -> Column:
    """At least ``min_lines // 2`` lines of the block say something."""
    counted = [f"CAST({block}[{i}] NOT IN {text.in_list(NOISE_LINES)} AS INT)" for i in range(min_lines)]
    return F.expr(f"{' + '.join(counted)} >= {min_lines // 2}")


def block_hash(block: str) -> Column:
    return F.md5(F.array_join(block, "\n"))


def hashed_windows(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``(path, start_line, hash)`` of the informative blocks."""
    rows = windows(files, min_lines).where(is_informative("block", min_lines))
    return rows.select("path", "start_line", block_hash("block").alias("hash"))


def _keyed(files: DataFrame, min_lines: int) -> DataFrame:
    return hashed_windows(files, min_lines).select("path", "start_line", F.unhex("hash").alias("key"))


def _by_file(files: DataFrame, min_lines: int) -> DataFrame:
    """``(path, places)``: each file's informative blocks as an array of line and key, in the file's row."""
    rows = files.selectExpr("path", f"{text.split_lines(text.normalize('content'))} AS normal")
    starts = f"IF(size(normal) >= {min_lines}, sequence(1, size(normal) - {min_lines - 1}), CAST(array() AS ARRAY<INT>))"
    rows = rows.selectExpr("path", f"transform({starts}, i -> named_struct('line', i, 'block', slice(normal, i, {min_lines}))) AS blocks")
    told = " + ".join(f"CAST(b.block[{i}] NOT IN {text.in_list(NOISE_LINES)} AS INT)" for i in range(min_lines))
    key = "unhex(md5(array_join(b.block, '\n')))"
    return rows.selectExpr("path", f"transform(filter(blocks, b -> {told} >= {min_lines // 2}), b -> named_struct('line', b.line, 'key', {key})) AS places")


def _numbered(paths: DataFrame) -> DataFrame:
    """``(path, file_no)``: 0, 1, 2 ... in the order of the paths, which are dealt out in ranges and numbered there."""
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = paths.repartitionByRange(parts, "path").sortWithinPartitions("path")
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the lower bits count within a partition
    ranges = scratch.stored(ranges.select("path", F.spark_partition_id().alias("part"), inside.alias("place")), "paths")
    counts = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))  # a row for each range
    return ranges.join(offsets, "part").select("path", (F.col("before") + F.col("place")).alias("file_no"))


def _has_key(keys: DataFrame, n: int) -> tuple[DataFrame, Column, Column]:
    """A filter for ``n`` keys: rows of a word's number and its bits (two of each key's), the word of a key, and the key's bits.

    With more keys than the words have room for, the filter lets more through, and nothing is lost.
    """
    words = 1 << max(0, min(FILTER_WORDS, n * BITS_A_KEY // 64) - 1).bit_length()
    digest = F.xxhash64("key")
    word = F.shiftrightunsigned(digest, 12).bitwiseAND(words - 1)
    bits = F.expr("shiftleft(1L, int(xxhash64(key) & 63)) | shiftleft(1L, int(shiftright(xxhash64(key), 6) & 63))")
    filled = keys.select(word.alias("word"), bits.alias("own")).groupBy("word").agg(F.bit_or("own").alias("bits"))
    return filled, word, bits


def _with_key(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose ``key`` is among ``n`` keys, and few others."""
    words, word, bits = _has_key(keys, n)
    return rows.withColumns({"word": word, "own": bits}).join(F.broadcast(words), "word").where("bits & own = own")


@dataclass(frozen=True)
class Blocks:
    """The hashed blocks of a corpus. Its text is read once, when one of the tables is first asked for."""

    files: DataFrame
    min_lines: int = MIN_LINES

    @cached_property
    def by_file(self) -> DataFrame:
        """``(path, places)``, stored."""
        return scratch.stored(_by_file(self.files, self.min_lines), "blocks")

    @cached_property
    def numbered(self) -> DataFrame:
        """``(path, file_no)`` of the files."""
        return _numbered(self.by_file.select("path"))

    @cached_property
    def line_bits(self) -> int:
        """Bits that a line takes beside its file's number in a place."""
        longest = self.by_file.agg(F.max(F.expr("get(places, size(places) - 1).line"))).first()[0] or 1
        return longest.bit_length()

    def groups(self) -> DataFrame:
        """``(hash, line_count, n_occ, first_path, first_line)`` of the blocks that occur at least twice."""
        shift = self.line_bits
        placed = self.by_file.join(self.numbered, "path").select("file_no", F.explode("places").alias("at"))
        place = F.expr(f"shiftleft(file_no, {shift}) | at.line")
        found = placed.select(F.col("at.key").alias("key"), place.alias("place"))
        found = found.groupBy("key").agg(F.count("*").alias("n_occ"), F.min("place").alias("first")).where("n_occ >= 2")
        found = found.withColumn("file_no", F.expr(f"shiftright(first, {shift})")).join(self.numbered, "file_no")
        return found.select(F.lower(F.hex("key")).alias("hash"), F.lit(self.min_lines).alias("line_count"), "n_occ",
                            F.col("path").alias("first_path"), F.expr(f"int(first & {(1 << shift) - 1})").alias("first_line"))

    def corpus_groups(self) -> DataFrame:
        """The groups of a scan: none for a corpus of one file."""
        return self.groups().where(has_two_files(self.by_file))

    def occurrences(self, group_rows: DataFrame, sent: int = 0) -> DataFrame:
        """``(hash, path, start_line)`` for every place of the given groups. Up to ``sent`` keys are broadcast as they are."""
        wanted = group_rows.select(F.unhex("hash").alias("key")).distinct()
        n = wanted.count()
        found = self.by_file.select("path", F.explode("places").alias("at")).select("path", "at.*")
        if n > sent:
            found = _with_key(found, wanted, n).select("path", "line", "key").join(wanted, "key")
        else:
            found = found.join(F.broadcast(wanted), "key")
        return found.select(F.lower(F.hex("key")).alias("hash"), "path", F.col("line").alias("start_line"))


def has_two_files(files: DataFrame) -> Column:
    """Scalar condition: the corpus has at least two files (reads no more than two rows)."""
    return files.select(F.lit(1).alias("one")).limit(2).agg(F.count("one") >= 2).scalar()


def _repeated(rows: DataFrame) -> DataFrame:
    """``(key, n_occ)`` of the keys that occur at least twice: only keys and counts are shuffled."""
    return rows.groupBy("key").agg(F.count("*").alias("n_occ")).where("n_occ >= 2")


def groups(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    return Blocks(files, min_lines).groups()


def corpus_groups(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    return Blocks(files, min_lines).corpus_groups()


def count_groups(files: DataFrame, min_lines: int = MIN_LINES, check_files: bool = True) -> DataFrame:
    """One row with the number of duplicate blocks: only keys and counts are shuffled.

    Without ``check_files`` a corpus of one file counts too; the debt totals, which know the number of
    files, use that to save a look at the corpus.
    """
    repeated = _repeated(_keyed(files, min_lines))
    if check_files:
        repeated = repeated.where(has_two_files(files))
    return repeated.agg(F.count("*").alias("duplicate_blocks"))


def ranked(group_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Groups by number of occurrences, most frequent first; ties by first place."""
    out = group_rows.orderBy(F.desc("n_occ"), "first_path", "first_line", "hash")
    return out if limit is None else out.limit(limit)


def first_files(files: DataFrame, group_rows: DataFrame) -> DataFrame:
    """The files with first places of the given groups, and few others: the text of the rest need not move for ``with_lines``.

    The groups are read here and there, so they should be stored.
    """
    wanted = group_rows.select(F.col("first_path").alias("key")).distinct()
    return _with_key(files.withColumn("key", F.col("path")), wanted, wanted.count()).select(*files.columns)


def with_lines(files: DataFrame, group_rows: DataFrame) -> DataFrame:
    """Adds the normalised lines of the first place, for any number of groups. A file is cut into lines once for all of its groups."""
    own = group_rows.groupBy("first_path").agg(F.collect_list(F.struct("hash", "line_count", "n_occ", "first_line")).alias("found"))
    rows = files.join(own, files["path"] == own["first_path"])
    rows = rows.selectExpr("first_path", f"{text.split_lines(text.normalize('content'))} AS normal", "found")
    rows = rows.selectExpr("first_path", "normal", "explode(found) AS block")
    return rows.selectExpr("block.hash", "slice(normal, block.first_line, block.line_count) AS lines", "block.line_count", "block.n_occ",
                           "first_path", "block.first_line")


def occurrences(files: DataFrame, group_rows: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    return Blocks(files, min_lines).occurrences(group_rows)


def statistics(group_rows: DataFrame, occurrence_rows: DataFrame) -> DataFrame:
    """One row: blocks, duplicated lines, distinct files that hold one of the blocks."""
    affected = occurrence_rows.agg(F.countDistinct("path")).scalar()
    counted = group_rows.agg(F.count("*").alias("blocks"),
                             F.coalesce(F.sum(F.col("line_count") * F.col("n_occ")), F.lit(0)).alias("duplicated_lines"))
    return counted.select("blocks", "duplicated_lines", affected.alias("affected_files"))
