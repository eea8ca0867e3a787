"""Benchmark decontamination by spaced seeds.

A seed hashes five words at the fixed places of a mask and ignores those between, so that a substituted word spoils only the
seeds that look at it. Seeds of the benchmark and of the documents are joined; each hit puts an item beside a document at one
offset, and there the longest stretch is sought of which at least PERCENT in a hundred words are equal. A document is
contaminated if such a stretch has at least WORDS words, or all of a shorter item.

Documents' seeds that can't be the benchmark's are left out by a bit filter of a fixed size, made from the benchmark's seeds;
a large benchmark fills it and leaves more to the join, which decides. Documents with a seed that passes are stored as hashes of
their words. At each offset that a hit gives, all words of the document that lie beside the item's are compared, so that a
stretch is whole however far its hits are apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored
from llm.near_dup import mixed, word_hashes, words_lower

#: Places of the words that a seed looks at. Of any 8 to 120 words of which 80 in a hundred are equal, some mask finds five.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 4, 6, 7))
WORDS = 13
PERCENT = 80
#: Items of fewer words are looked for word for word.
LEAST = 8
FILTER_BITS = 1 << 24
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def seeds_of(words: np.ndarray, number: int) -> np.ndarray:
    """The hash of each place where the mask fits; from number len(MASKS) on, of each run of 1, 2, ... words."""
    mask = MASKS[number] if number < len(MASKS) else range(number - len(MASKS) + 1)
    size = len(words) - mask[-1]
    if size <= 0:
        return np.zeros(0, np.uint64)
    hashes = np.full(size, number + 1, np.uint64)
    for place in mask:
        hashes = (hashes ^ words[place : place + size]) * _GOLDEN
        hashes ^= hashes >> np.uint64(29)
    return mixed(hashes)


def _numbers(n_words: int) -> list[int]:
    """The kinds of seeds of an item: the masks, or, for a short one, the run of all its words."""
    return list(range(len(MASKS))) if n_words >= LEAST else [len(MASKS) + n_words - 1] if n_words else []


def _items(benchmark: DataFrame, short: bool) -> tuple[DataFrame, DataFrame]:
    """item (a number for each row), item_id, words (hashes); and seed, item, at."""
    own = benchmark.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(own.dtypes)["item_id"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes().of(words_lower(text)) for text in batch.column(1).to_pylist()]
            seeds, places = [], []
            for own_words in words:
                each = [np.zeros(0, np.uint64), *(seeds_of(own_words, n) for n in _numbers(len(own_words)))]
                seeds.append(np.concatenate(each).view(np.int64))
                places.append(np.concatenate([np.arange(len(s)) for s in each]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in ([w.view(np.int64) for w in words], seeds, places))], ["item_id", "words", "seeds", "places"])

    made = own.mapInArrow(hashed, f"item_id {kind}, words array<bigint>, seeds array<bigint>, places array<bigint>")
    items = stored(made.where(F.size("words") >= (1 if short else LEAST)).withColumn("item", F.monotonically_increasing_id()), "items")
    each = items.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(F.col("s.seeds").alias("seed"), "item", F.col("s.places").alias("at"))
    return items.select("item", "item_id", "words"), each.distinct()


def _filter(seeds: DataFrame) -> np.ndarray:
    """Two bits for each seed; the rows that reach the driver are at most FILTER_BITS / 64, whatever the benchmark's size."""
    bits = seeds.select(F.explode(F.array(F.col("seed").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(FILTER_BITS - 1))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words:
        filled[row["word"]] = row["bits"]
    return filled.view(np.uint8)


def _passes(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the seeds whose two bits are set."""
    low = (seeds & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    at = np.flatnonzero((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
    high = ((seeds[at] >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return at[((bits[high >> 3] >> (high & 7).astype(np.uint8)) & 1).astype(bool)]


def _touched(texts: DataFrame, bits: np.ndarray, numbers: list[int]) -> DataFrame:
    """texts: key, text; numbers: kinds of seeds. Of the texts with a seed that passes: doc (a number for each row), key, words
    (hashes of all of them), seeds and places of those that pass."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, words, seeds, places = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                own = word_hashes().of(words_lower(text.as_py()))
                found = []
                for kind in numbers:
                    hashes = seeds_of(own, kind)
                    at = _passes(hashes, shared.value)
                    found.append((at, hashes[at]))
                place = np.concatenate([at for at, _ in found])
                if len(place):
                    rows.append(row)
                    words.append(own.view(np.int64))
                    seeds.append(np.concatenate([s for _, s in found]).view(np.int64))
                    places.append(place)
            longs = pa.list_(pa.int64())
            docs = pa.array(np.arange(number, number + len(rows)), pa.int64())
            number += len(rows)
            yield pa.RecordBatch.from_arrays([docs, batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, longs) for x in (words, seeds, places))], ["doc", "key", "words", "seeds", "places"])

    return texts.mapInArrow(cut, "doc bigint, key string, words array<bigint>, seeds array<bigint>, places array<bigint>")


def longest_alike(equal: np.ndarray, percent: int) -> tuple[int, int, int]:
    """Start, end and number of equal places of the longest stretch of which at least percent in a hundred are equal."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    least = np.minimum.accumulate(sums)  # falls, so the first start that is low enough is found by halving
    start = np.searchsorted(-least, -sums, side="left")
    length = np.arange(len(sums)) - start
    end = int(np.argmax(length))
    return int(start[end]), end, int(np.count_nonzero(equal[start[end] : end]))


def _compared(beside: DataFrame, words: int, percent: int) -> DataFrame:
    """beside: key, start, words, item_id, item_words, before: a document's words from start on lie beside the item's, of which
    `before` come earlier. Returns the stretches that contaminate."""
    kind = dict(beside.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], [[], [], []]
            for row, (start, own, item, before) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(4), batch.column(5).to_pylist(), strict=True)):
                own, item = own.values.to_numpy(), item.values.to_numpy()
                if not len(own):
                    continue
                first, last, equal = longest_alike(own == item[before : before + len(own)], percent)
                if last - first >= min(words, len(item)) and (len(item) >= LEAST or equal == len(item)):
                    rows.append(row)
                    for column, value in zip(columns, (start + first, last - first, equal), strict=True):
                        column.append(value)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(3).take(at), *(pa.array(c, pa.int64()) for c in columns)], ["key", "item_id", "first_word", "n_words", "n_equal"])

    return beside.mapInArrow(run, f"key string, item_id {kind}, first_word bigint, n_words bigint, n_equal bigint")


def overlaps(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT, short: bool = True) -> DataFrame:
    """docs: text; benchmark: item_id, text; other columns are left aside. Returns key (MD5 of the text), item_id, first_word,
    n_words, n_equal: stretches that contaminate, the longest for each offset of an item. short: items of 1 to LEAST - 1 words,
    which can match by chance, count too, where a document holds them word for word.

    Words as in near-duplicates: A-Z as a-z, other white space than the six ASCII characters belongs to words. Null texts are
    empty: nothing overlaps. Repeated items and documents give their own rows; a null item_id stays null. Empty tables give
    no rows."""
    items, seeds = _items(benchmark, short)
    seeds = stored(seeds, "seeds")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    short_sizes = [r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < LEAST).distinct().collect()] if short else []
    numbers = [*range(len(MASKS)), *(number for n in sorted(short_sizes) for number in _numbers(n))]
    touched = stored(_touched(docs.select(F.md5(text).alias("key"), text.alias("text")), _filter(seeds), numbers), "touched")
    hits = touched.select("doc", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("doc", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    shifts = hits.join(seeds, "seed").select("doc", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    sized = shifts.join(items.select("item", F.size("words").alias("n")), "item")
    region = "slice(words, int(greatest(shift, 0L)) + 1, int(least(size(words), shift + n) - greatest(shift, 0L)))"
    regions = sized.join(touched.select("doc", "key", "words"), "doc").selectExpr("key", "item", "greatest(shift, 0L) AS start", f"{region} AS words", "greatest(-shift, 0L) AS before")
    beside = regions.join(items.withColumnRenamed("words", "item_words"), "item")
    return _compared(beside.select("key", "start", "words", "item_id", "item_words", "before"), words, percent)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs: doc_id, text. Returns for each row doc_id, n_items, n_words (of the longest stretch), item_ids (ascending), kept."""
    found = overlaps(docs, benchmark, **options).groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_words").alias("n_words"))
    found = found.select("key", "item_ids", "n_words", F.lit(True).alias("hit"))
    own = docs.select("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    kind = f"array<{dict(benchmark.dtypes)['item_id']}>"
    return own.join(found, "key", "left").select("doc_id", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
                                                 F.coalesce("item_ids", F.array().cast(kind)).alias("item_ids"), F.col("hit").isNull().alias("kept"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, all columns as they are."""
    found = stored(overlaps(docs, benchmark, **options).select("key").distinct(), "contaminated")
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    return own.join(found, "key", "left_anti").select("row.*")
