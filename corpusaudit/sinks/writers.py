"""Sinks: result tables as JSON or as versions of Parquet tables, written by the tasks."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusaudit.functions.text import round_half_even
from corpusaudit.sinks import scratch


def slim_issues(issues: DataFrame) -> DataFrame:
    return issues.select(F.col("rule_id").alias("rule"), "severity", F.col("path").alias("file"), "line", "message")


def full_issues(issues: DataFrame) -> DataFrame:
    return issues.select("rule_id", "rule_name", "category", "severity", "message", F.col("path").alias("file"), "line",
                         "column", "snippet", "suggestion", "confidence")


def full_files(profile: DataFrame) -> DataFrame:
    return profile.select("path", "language", "lines", "code_lines", "comment_lines", "blank_lines", "functions", "classes",
                          "max_complexity", F.expr(round_half_even("avg_complexity", 2)).alias("avg_complexity"), "issue_count")


def document(headline: DataFrame, debt: DataFrame, counts: dict[str, DataFrame], files: DataFrame, issues: DataFrame,
             blocks: DataFrame, places: DataFrame) -> DataFrame:
    """One nested row of a small result: summary, counts as maps, debt, files by path, issues in the order of the report,
    and duplicate blocks, most frequent first, with their places."""
    def one(table, value):
        return table.agg(value.alias("value")).scalar()

    def pairs(table):
        key, value = table.columns
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))

    listed = full_issues(issues)
    order = F.struct("path", "rule_ord", "line", "message")
    in_order = issues.select(order.alias("order"), F.struct(*listed.columns[:5], F.col("path").alias("file"), *listed.columns[6:]).alias("issue"))
    at = places.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("path", F.col("start_line").alias("line")))).alias("occurrences"))
    block = F.struct("hash", "lines", "line_count", "occurrences")
    in_rank = blocks.join(at, "hash").select(F.struct(-F.col("n_occ"), "first_path", "first_line", "hash").alias("order"), block.alias("block"))
    by_path = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct(*files.columns[1:])))))
    return headline.select(
        "target", F.struct("files_scanned", "files_with_issues", "total_issues", F.round("elapsed", 3).alias("scan_time_seconds")).alias("summary"),
        *[one(table, pairs(table)).alias(name) for name, table in counts.items() if name != "languages"],
        one(debt, F.first(F.struct(*debt.columns))).alias("tech_debt"), one(counts["languages"], pairs(counts["languages"])).alias("languages"),
        one(files, by_path).alias("files"),
        one(in_order, F.transform(F.array_sort(F.collect_list(F.struct("order", "issue"))), lambda x: x["issue"])).alias("issues"),
        one(in_rank, F.transform(F.array_sort(F.collect_list(F.struct("order", "block"))), lambda x: x["block"])).alias("duplicates"))


def checkpointed(table: DataFrame) -> DataFrame:
    """Computes a result once and keeps it in the shared folder, which outlives executors."""
    sc = table.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch.shared_folder(table.sparkSession))
    return table.checkpoint()


def write_json(tables: dict[str, DataFrame], folder: str, compression: str | None = None) -> dict[str, StructType]:
    """One folder of JSON lines per table, compressed if a codec of Spark's writer (``gzip``) is given; gives the tables' schemas."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(os.path.join(folder, name), compression=compression)
    return {name: table.schema for name, table in tables.items()}


# --- versioned tables -------------------------------------------------------------------------

VERSIONS = "versions"
VERSION_SCHEMA = "version bigint, path string, tables array<string>"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """``(version, path, tables)`` of the committed versions in a folder; none where nothing was written."""
    try:
        return spark.read.schema(VERSION_SCHEMA).json(f"{folder.rstrip('/')}/{VERSIONS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSION_SCHEMA)


class Version:
    """A set of tables in a folder of its own, which readers see when it is committed, whole or not at all.

    Committing adds one row to the list of versions. Earlier versions stay for those who still read them;
    a run that fails before the commit leaves files that no row names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), []
        self.path = f"{self.folder}/version-{uuid.uuid4().hex}"

    def write(self, name: str, table: DataFrame) -> DataFrame:
        """Writes a Parquet table and gives it back as a scan of what was written."""
        table.write.parquet(f"{self.path}/{name}")
        self.names.append(name)
        return self.spark.read.schema(table.schema).parquet(f"{self.path}/{name}")

    def commit(self) -> None:
        last = versions(self.spark, self.folder).agg(F.max("version")).first()[0]
        row = self.spark.createDataFrame([((last or 0) + 1, self.path, self.names)], VERSION_SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{self.folder}/{VERSIONS}")


def read_tables(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last committed version, or of the given one, by name."""
    found = versions(spark, folder).where(F.lit(True) if version is None else F.col("version") == version)
    row = found.orderBy(F.desc("version"), "path").first()
    if row is None:
        raise FileNotFoundError(f"No version in {folder}")
    return {name: spark.read.parquet(f"{row['path']}/{name}") for name in row["tables"]}
