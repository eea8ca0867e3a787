"""What the operators share: stored tables, running positions, word lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusaudit.sinks.scratch import discard, fresh_path, shared_folder, stored  # noqa: F401

#: A word is a run of anything but these six ASCII characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPLIT_WORDS = re.compile(r"[\x20\x09-\x0D]+").split
#: Characters that str.split() takes for white space and the word pattern does not.
OTHER_SPACES = re.compile("[\x1c-\x1f%s]" % "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))).search


def words_of(text: str) -> list[str]:
    """The words of WORD_PATTERN, in order."""
    if OTHER_SPACES(text) is None:
        return text.split()
    return [w for w in SPLIT_WORDS(text) if w]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), name: str = "position", total: str | None = None) -> DataFrame:
    """Adds each row's 0-based place in the given order, within its group if groups are given, without bringing a group
    into one task: rows are dealt out in ranges of groups and order, stored with the range's number, numbered within each
    range, and moved by the number of the group's rows in the ranges before. Ties fall in any order. total: the name of a
    further column with the number of the group's rows."""
    group_columns = [F.col(g) for g in groups]
    part = f"{name}_range"
    dealt = df.repartitionByRange(partitions(df.sparkSession), *group_columns, *order).withColumn(part, F.spark_partition_id())
    dealt = stored(dealt, name)
    counts = dealt.groupBy(part, *groups).agg(F.count("*").alias(f"{name}_rows"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{name}_before": F.coalesce(F.sum(f"{name}_rows").over(before), F.lit(0))}
    if total:
        sums[total] = F.sum(f"{name}_rows").over(Window.partitionBy(*groups))
    offsets = counts.select(part, *groups, *(value.alias(column) for column, value in sums.items()))
    within = Window.partitionBy(part, *groups).orderBy(*order)
    numbered = dealt.withColumn(name, F.row_number().over(within) - 1)
    on = [numbered[part] == offsets[part], *(numbered[g].eqNullSafe(offsets[g]) for g in groups)]
    return numbered.join(offsets, on).select(*(numbered[c] for c in df.columns), (numbered[name] + offsets[f"{name}_before"]).alias(name), *([offsets[total]] if total else []))
