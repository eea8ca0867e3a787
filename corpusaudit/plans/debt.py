"""Technical debt, quality score, grade and risk: arithmetic on one row of totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions.text import round_half_even
from corpusaudit.plans.detect import CATEGORY_COUNTS, SEVERITY_COUNTS

# --- fixed values -----------------------------------------------------------------------------
COMPLEXITY_LIMIT, COMPLEXITY_MINUTES = 10, 10
DUPLICATE_MINUTES = 30
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
LOWEST_GRADE = "F"
# --- end of fixed values ----------------------------------------------------------------------


def totals(profile: DataFrame, duplicate_blocks: DataFrame | None = None, min_severity: str = "info",
           check_files: bool = False) -> DataFrame:
    """One row of sums over the corpus.

    ``min_severity`` narrows ``total_issues`` alone, the way a severity-filtered scan mixes filtered
    and unfiltered numbers; the counts per severity and category stay whole.
    ``check_files`` drops the duplicate blocks (a one-row count) of a corpus with fewer than two files.
    """
    def total(column):
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    counted = [SEVERITY_COUNTS[s] for s, order in dims.SEVERITY_ORDER.items() if order <= dims.SEVERITY_ORDER[min_severity]]
    row = profile.agg(
        F.count("*").alias("files_scanned"), F.count_if(F.col("issue_count") > 0).alias("files_with_issues"),
        total(reduce(Column.__add__, [F.col(c) for c in counted])).alias("total_issues"),
        total(F.col("code_lines")).alias("total_code_lines"), total(_complexity_minutes()).alias("complexity_minutes"),
        *[total(F.col(c)).alias(c) for c in [*SEVERITY_COUNTS.values(), *CATEGORY_COUNTS.values()]])
    blocks = F.lit(0) if duplicate_blocks is None else F.coalesce(duplicate_blocks.scalar(), F.lit(0))
    if check_files:
        blocks = F.when(F.col("files_scanned") >= 2, blocks).otherwise(0)
    return row.withColumn("duplicate_blocks", blocks.cast("bigint"))


def _complexity_minutes() -> Column:
    return F.greatest(F.col("max_complexity") - COMPLEXITY_LIMIT, F.lit(0)) * COMPLEXITY_MINUTES


def complexity_debt(statistics: DataFrame) -> DataFrame:
    """Minutes for files beyond the complexity limit; file statistics suffice, no rule has to run."""
    return statistics.agg(F.coalesce(F.sum(_complexity_minutes()), F.lit(0)).alias("minutes"))


def severity_minutes() -> dict[str, Column]:
    return {s: F.col(SEVERITY_COUNTS[s]) * minutes for s, minutes in dims.FIX_MINUTES.items()}


def debt_by_severity(total_row: DataFrame) -> DataFrame:
    """``(kind, minutes)``: the five severities, then complexity and duplicates."""
    parts = {**severity_minutes(), "complexity": F.col("complexity_minutes"),
             "duplicates": F.col("duplicate_blocks") * DUPLICATE_MINUTES}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("bigint").alias("minutes")) for k, v in parts.items()])
    return total_row.select(F.inline(pairs))


def issues_per_kloc() -> Column:
    return F.when(F.col("total_code_lines") > 0, F.col("total_issues") / F.col("total_code_lines") * 1000).otherwise(0.0)


def quality_score() -> Column:
    """0 to 100, unrounded; 100 without code."""
    weighted = reduce(Column.__add__, [F.col(SEVERITY_COUNTS[s]) * w for s, w in dims.SEVERITY_WEIGHT.items()])
    penalty = F.least(issues_per_kloc() * 2 + weighted * 0.01, F.lit(90.0))
    return F.when(F.col("total_code_lines") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - penalty))


def grade(score: Column) -> Column:
    out = None
    for limit, letter in GRADES:
        out = F.when(score >= limit, letter) if out is None else out.when(score >= limit, letter)
    return out.otherwise(LOWEST_GRADE)


def risk_level(score: Column) -> Column:
    return F.when((F.col("n_critical") > 0) | (score < 40), "critical") \
        .when((F.col("n_high") > 3) | (score < 60), "high").when(score < 80, "medium").otherwise("low")


def formatted(minutes: Column) -> Column:
    """"1d 2h 3m" with 8-hour days, without days below one."""
    def whole(x):
        return F.floor(x).cast("bigint").cast("string")

    hours = F.floor(minutes / 60)
    rest = F.concat(whole(minutes % 60), F.lit("m"))
    short = F.concat(whole(hours), F.lit("h "), rest)
    return F.when(hours >= 8, F.concat(whole(hours / 8), F.lit("d "), whole(hours % 8), F.lit("h "), rest)).otherwise(short)


def measures(total_row: DataFrame) -> DataFrame:
    """The totals with every derived debt and quality figure, flat."""
    minutes = reduce(Column.__add__, severity_minutes().values()) + F.col("complexity_minutes") \
        + F.col("duplicate_blocks") * DUPLICATE_MINUTES
    row = total_row.withColumns({"total_debt_minutes": minutes.cast("bigint"), "score": quality_score(), "kloc": issues_per_kloc()})
    m, score = F.col("total_debt_minutes"), F.col("score")
    return row.select(
        "*", F.expr(round_half_even("total_debt_minutes / 60", 1)).alias("total_debt_hours"),
        F.expr(round_half_even("total_debt_minutes / 480", 1)).alias("total_debt_days"),
        formatted(m).alias("formatted"), F.expr(round_half_even("score", 1)).alias("quality_score"), grade(score).alias("grade"),
        risk_level(score).alias("risk_level"), F.expr(round_half_even("kloc", 2)).alias("issues_per_kloc"))


def breakdown_columns() -> list[Column]:
    return [F.col("n_security").alias("security_issues"), F.col("n_bug").alias("bug_issues"),
            F.col("n_complexity").alias("complexity_issues"), F.col("n_style").alias("style_issues"),
            F.col("duplicate_blocks"), F.col("files_with_issues"), F.col("files_scanned")]


def tech_debt(total_row: DataFrame) -> DataFrame:
    """The debt report as one nested row."""
    by_severity = F.create_map(*[x for s, v in severity_minutes().items() for x in (F.lit(s), v.cast("bigint"))],
                               F.lit("complexity"), F.col("complexity_minutes"),
                               F.lit("duplicates"), (F.col("duplicate_blocks") * DUPLICATE_MINUTES).cast("bigint"))
    return measures(total_row).select(
        "total_debt_minutes", "total_debt_hours", "total_debt_days", "formatted",
        by_severity.alias("debt_by_severity"), "quality_score", "grade", "risk_level", "issues_per_kloc",
        "total_code_lines", F.struct(*breakdown_columns()).alias("breakdown"))
