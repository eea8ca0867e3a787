"""Counts and rankings over issue rows and file profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import text

RULE_KEY = ("rule_id", "rule_name")


def _zero_filled(dimension: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    counted = issues.groupBy(key).agg(F.count("*").alias("issues"))
    return dimension.join(counted, key, "left").select(key, F.coalesce("issues", F.lit(0)).alias("issues"))


def count_by_severity(issues: DataFrame) -> DataFrame:
    """``(severity, issues)`` for all five severities."""
    return _zero_filled(dims.dim_severity(issues.sparkSession), issues, "severity")


def count_by_category(issues: DataFrame) -> DataFrame:
    """``(category, issues)`` for all six categories."""
    return _zero_filled(dims.dim_category(issues.sparkSession), issues, "category")


def count_by_rule(issues: DataFrame) -> DataFrame:
    """``(rule, issues)`` with the rule as "id name"; rules without issues are absent."""
    counted = issues.groupBy(*RULE_KEY).agg(F.count("*").alias("issues"))
    return counted.select(F.concat_ws(" ", *RULE_KEY).alias("rule"), "issues")


def count_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy(F.expr(text.language("path")).alias("language")).agg(F.count("*").alias("files"))


def scan_totals(profile: DataFrame, elapsed: float = 0.0) -> DataFrame:
    """Files and issues of a scan that took ``elapsed`` seconds, by the caller's clock."""
    return profile.agg(F.count("*").alias("files_scanned"), F.count_if(F.col("issue_count") > 0).alias("files_with_issues"),
                       F.coalesce(F.sum("issue_count"), F.lit(0)).alias("total_issues"),
                       F.lit(float(elapsed)).alias("elapsed"))


def issues_for_file(issues: DataFrame, path: str) -> DataFrame:
    return issues.where(F.col("path") == path).orderBy("rule_ord", "line")


def top_files(profile: DataFrame, n: int = 10) -> DataFrame:
    """Files by risk (sum of issue scores), files without issues included."""
    return profile.select("path", F.col("score").alias("risk_score"), "issue_count") \
        .orderBy(F.desc("risk_score"), "path").limit(n)


def top_rules(issues: DataFrame, n: int = 5) -> DataFrame:
    return count_by_rule(issues).orderBy(F.desc("issues"), "rule").limit(n)


def file_statistics(profile: DataFrame) -> DataFrame:
    """The per-file row: line classes, definitions, complexity, issue count, comment ratio."""
    ratio = F.when(F.col("code_lines") == 0, 0.0).otherwise(F.col("comment_lines") / F.col("code_lines"))
    return profile.select("path", "language", "lines", "blank_lines", "comment_lines", "code_lines", "functions",
                          "classes", "max_complexity", "avg_complexity", "issue_count", ratio.alias("comment_ratio"))
