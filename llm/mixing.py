"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source gets a share of the words of the mix. Within a source every document has the same expected number of copies,
target / size of the source; the running sum of expected copies, begun at one random offset per source, gives a copy of a
document for each integer it crosses there. The running sum is taken in the order of document sizes, so that the copies
take small and large documents alike and the words taken come within about the source's longest document of the target.
No document gets more than ceil(expected) copies, hence at most `most_copies`.

Sources and their sizes are one row per source; of each round of sharing one row with three numbers reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import WORD_PATTERN, positions, stored

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = "mix"


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _exact(value: int | Column) -> Column:
    return (F.lit(str(value)) if isinstance(value, int) else value).cast("decimal(38,0)")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """sizes: (source, source_size), a row per source. Returns source, source_size, target.

    Weights go round the sources in code point order, null last. Targets share share_percent of all sizes by weight and stop
    at most_copies times the source's size; what is above goes to the others by weight until no target is above."""
    placed = positions(sizes, [F.col("source").asc_nulls_last()], name="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighted = stored(placed.select("source", "source_size", weight.alias("weight")), "weights")
    size, weight = F.col("source_size"), F.col("weight")
    total = int(weighted.agg(F.sum(_exact(size))).first()[0] or 0)
    full, capped = F.lit(False), None  # no source is at its limit at first
    while True:
        # what is left to share, times 100, over the weights of the sources that are not at their limit
        row = weighted.agg(F.count_if(full).alias("n"), F.sum(F.when(full, _exact(size))).alias("size"), F.sum(F.when(~full, weight)).alias("weight")).first()
        left, parts = share_percent * total - 100 * most_copies * int(row["size"] or 0), int(row["weight"] or 0)
        if row["n"] == capped or not parts:
            break
        capped = row["n"]
        full = full | (_exact(weight) * _exact(left) > _exact(size) * _exact(100 * most_copies * parts))
    target = F.when(full, (size * most_copies).cast("double")).otherwise(weight.cast("double") * F.lit(float(left)) / F.lit(100.0 * max(parts, 1)))
    return weighted.select("source", "source_size", target.alias("target"))


def random_offset(source: Column, seed: str) -> Column:
    """In [0, 1), from the source's name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """docs: doc_id, text, source; other columns are left aside. Returns a row per row of docs: doc_id, source, size,
    content (hash of the text), source_size, target, copies.

    Null or empty texts have size 0: they get copies like others and add no words. Null sources are one source. A source
    without words has target 0 and no copies. Repeated rows are rows of their own. An empty table gives no rows."""
    own = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_in_words(F.col("text")).alias("size"), F.md5("text").alias("content")), "sizes")
    targets = source_targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, most_copies)
    order = [F.col("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("content")]
    placed = positions(own, order, ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset, place = random_offset(placed["source"], seed), F.col("position").cast("double")
    crossed = F.floor(rate * (place + 1.0) + offset) - F.floor(rate * place + offset)
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["source"]))
    return joined.select("doc_id", placed["source"], "size", "content", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as it has copies, all columns as they are.

    Rows that agree in doc_id, source and text are told apart by a number only, so that each gets its own copies."""
    key = ["doc_id", "source", "content"]
    numbered = Window.partitionBy("key").orderBy("key")
    as_key = F.md5(F.concat_ws("\0", *(F.coalesce(F.concat(F.lit("s"), F.col(k).cast("string")), F.lit("n")) for k in key)))
    taken = copies(docs, **options).select(as_key.alias("key"), F.col("copies"))
    taken = taken.select("key", "copies", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("copies"))).alias("number")).where("copies > 0")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), F.md5("text").alias("content"))
    rows = rows.select("row", as_key.alias("key")).withColumn("number", F.row_number().over(numbered))
    kept = rows.join(taken, ["key", "number"])
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
