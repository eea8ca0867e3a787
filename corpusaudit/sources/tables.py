"""Tables as corpora: any DataFrame with a path-like key and a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import text


def corpus(table: DataFrame, path: Column, content: Column, splits: int | None = None) -> DataFrame:
    """``(path, content)`` files from a table; ``path`` must name each file once. Null text is empty text.

    ``splits`` shuffles the table into that many parts first. It is for tables of few large row groups,
    which would keep few cores busy; a table with enough of them is better read as it lies.
    """
    if splits:
        table = table.repartition(splits)
    return table.select(path.alias("path"), F.coalesce(content, F.lit("")).alias("content"))


def with_language(files: DataFrame) -> DataFrame:
    return files.selectExpr("path", "content", f"{text.language('path')} AS language")


def describe(files: DataFrame) -> DataFrame:
    """``(path, content, n_bytes, ext, language)``."""
    return files.selectExpr("path", "content", "CAST(octet_length(content) AS BIGINT) AS n_bytes",
                            f"{text.extension('path')} AS ext", f"{text.language('path')} AS language")
