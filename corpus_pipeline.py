"""A training-data pipeline over documents: each stage is written as Parquet and read again as the next one's input.

Rejected documents go, one document of each near-duplicate group stays, contaminated documents go, sources are mixed to their
weights (a document may come twice), and the mix is written as token files, of which the last stage returns a row for each
document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import decontam, mixing, near_dup, quality, token_files
from llm.common import fresh_path, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and trees keep. A null or empty text has no words and is rejected; repeated rows are judged
    alike; labels of documents that aren't there don't count; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """On shingles of five words, at a similarity of 0.8: the row of the smallest doc_id of each group (one of rows that agree
    in it), those without doc_id last. Rows without words, null texts among them, all stay; an empty table stays empty."""
    return near_dup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch of 13 words or more (or all of a shorter item) of which 80 in a hundred are a benchmark
    item's, short items word for word. Null and empty texts and items overlap nothing; repeated rows go or stay together; an
    empty benchmark keeps all."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents none, one or two times, so that its words come near its target. A null source is a source;
    documents without words come like others and add none; an empty table stays empty."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and a row for each document read back from them. A null or empty text is the end id alone; null doc_ids
    come first; rows of one doc_id follow each other by text; an empty table gives no files and no rows."""
    manifest = token_files.write(docs, fresh_path(spark, "tokens"))
    return token_files.read(manifest, dict(docs.dtypes)["doc_id"]).drop("path")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("token_output", token_output)]
#: The first stage's trees have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
