"""Report queries: each is a function of the issue rows, the file profiles or the duplicate groups.

Limits are parameters with the usual report sizes as defaults; the aggregates look at whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions.text import case_of, round_half_even
from corpusaudit.plans import debt, rollups

ISSUE_ORDER = ("path", "rule_ord", "line")


def _average():
    """Mean complexity with two digits."""
    return F.expr(round_half_even("avg_complexity", 2)).alias("avg_complexity")


def _severity_order():
    return F.expr(case_of("severity", {str(order): [name] for name, order in dims.SEVERITY_ORDER.items()}))


# --- scan command -----------------------------------------------------------------------------

def min_severity(issues: DataFrame, level: str) -> DataFrame:
    """Issues at least as severe as ``level``."""
    kept = [s for s, order in dims.SEVERITY_ORDER.items() if order <= dims.SEVERITY_ORDER[level]]
    return issues.where(F.col("severity").isin(kept))


def gate(issues: DataFrame, level: str = "info", no_fail: bool = False) -> DataFrame:
    """One row with the verdict: fail when filtered issues exist and any issue is critical or high."""
    kept = [s for s, order in dims.SEVERITY_ORDER.items() if order <= dims.SEVERITY_ORDER[level]]
    counted = issues.agg(F.count_if(F.col("severity").isin(kept)).alias("total_issues"),
                         F.count_if(F.col("severity") == "critical").alias("critical"),
                         F.count_if(F.col("severity") == "high").alias("high"))
    failed = (F.col("total_issues") > 0) & ((F.col("critical") > 0) | (F.col("high") > 0)) & F.lit(not no_fail)
    return counted.withColumn("failed", failed)


def headline(total_row: DataFrame, target: str = "", elapsed: float = 0.0) -> DataFrame:
    """The 12 figures of the statistics view; what was scanned and the seconds it took are the caller's."""
    return debt.measures(total_row).select(
        "files_scanned", "files_with_issues", "total_issues", "quality_score", "grade", "risk_level",
        F.col("formatted").alias("tech_debt"), F.col("total_debt_minutes").alias("tech_debt_minutes"),
        "issues_per_kloc", "total_code_lines", F.lit(target).alias("target"), F.lit(float(elapsed)).alias("elapsed"))


def summary(total_row: DataFrame, profile: DataFrame, issues: DataFrame, top: int = 5) -> DataFrame:
    """The text summary as rows ``(section, position, label, value)``: severities and categories that have
    issues, the riskiest files and the most frequent rules. The totals are folded out of their one row."""
    severities = F.array(*[F.struct(F.lit(s).alias("label"), F.col(f"n_{s}").alias("value"), F.lit(o).alias("position"))
                           for s, o in dims.SEVERITY_ORDER.items()])
    # most issues first, equal counts in catalogue order
    by_count = F.array_sort(F.array(*[
        F.struct((-F.col(f"n_{c}")).alias("minus"), F.lit(i).alias("ord"), F.lit(c).alias("label"))
        for i, c in enumerate(dims.CATEGORIES)]))
    sev = total_row.select(F.inline(severities)).where("value > 0").select(
        F.lit("severity").alias("section"), (F.col("position") + 1).alias("position"), "label", "value")
    cat = total_row.select(F.posexplode(by_count).alias("pos", "c")).where("c.minus < 0").select(
        F.lit("category").alias("section"), (F.col("pos") + 1).alias("position"), F.col("c.label").alias("label"),
        (-F.col("c.minus")).alias("value"))
    files = _numbered(rollups.top_files(profile, top), "file", "risk_score", "path", "issue_count")
    rules = _numbered(rollups.top_rules(issues, top), "rule", "issues", "rule", "issues")
    return sev.unionByName(cat).unionByName(files).unionByName(rules)


def _numbered(top_rows: DataFrame, section: str, rank_by: str, label: str, value: str) -> DataFrame:
    """Positions in a top-k: its k rows fit in one array, which is taken apart in order."""
    packed = top_rows.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col(rank_by)).alias("minus"), F.col(label).alias("label"), F.col(value).alias("value")))).alias("all"))
    return packed.select(F.posexplode("all").alias("pos", "r")).select(
        F.lit(section).alias("section"), (F.col("pos") + 1).alias("position"), F.col("r.label").alias("label"),
        F.col("r.value").alias("value"))


# --- issue lists ------------------------------------------------------------------------------

def find_issues(issues: DataFrame, severity: str | None = None, file: str | None = None, limit: int = 200) -> DataFrame:
    """Issues of one severity whose path holds a substring, the first ``limit`` in scan order."""
    if severity:
        issues = issues.where(F.col("severity") == severity)
    if file:
        issues = issues.where(F.contains("path", F.lit(file)))
    return issues.orderBy(*ISSUE_ORDER, "message").limit(limit)


def search_matches(issues: DataFrame, severity: str | None = None, text: str | None = None) -> DataFrame:
    """Issues of one severity whose message, path or rule id holds a text, whatever its case."""
    if severity:
        issues = issues.where(F.col("severity") == severity)
    if text:
        wanted = F.lit(text.lower())
        issues = issues.where(F.contains(F.lower("message"), wanted) | F.contains(F.lower("path"), wanted)
                              | F.contains(F.lower("rule_id"), wanted))
    return issues


def search_count(issues: DataFrame, severity: str | None = None, text: str | None = None) -> DataFrame:
    return search_matches(issues, severity, text).agg(F.count("*").alias("issues"))


def search(issues: DataFrame, severity: str | None = None, text: str | None = None, limit: int = 300) -> DataFrame:
    return search_matches(issues, severity, text).orderBy(*ISSUE_ORDER, "message").limit(limit)


def sorted_by_file(issues: DataFrame) -> DataFrame:
    """Full listing by path and line (a range-partitioned sort)."""
    return issues.orderBy("path", "line", "rule_ord", "message")


def sorted_by_severity(issues: DataFrame) -> DataFrame:
    return issues.orderBy(_severity_order(), "path", "line", "rule_ord", "message")


def security_totals(issues: DataFrame) -> DataFrame:
    found = issues.where(F.col("category") == "security")
    return found.agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "critical").alias("critical"),
                     F.count_if(F.col("severity") == "high").alias("high"),
                     F.countDistinct("path").alias("affected_files"))


def security_rules(issues: DataFrame) -> DataFrame:
    found = rollups.count_by_rule(issues.where(F.col("category") == "security"))
    return found.orderBy(F.desc("issues"), "rule")


def security_issues(issues: DataFrame, limit: int = 100) -> DataFrame:
    return issues.where(F.col("category") == "security").orderBy(*ISSUE_ORDER, "message").limit(limit)


# --- file lists -------------------------------------------------------------------------------

def file_list(profile: DataFrame) -> DataFrame:
    """Statistics of every file, most issues first."""
    return profile.select("path", "language", "lines", "code_lines", "comment_lines", "functions", "classes",
                          "max_complexity", _average(),
                          "issue_count").orderBy(F.desc("issue_count"), "path")


def file_detail(profile: DataFrame, issues: DataFrame, path: str) -> DataFrame:
    """One nested row with the statistics and issues of a file; no row when the path is unknown."""
    stats = profile.where(F.col("path") == path).select("path", F.struct(
        "language", "lines", "code_lines", "comment_lines", "functions", "classes", "max_complexity",
        _average()).alias("stats"))
    row = F.struct("rule_ord", "line", "rule_id", "severity", "message", "snippet")
    found = issues.where(F.col("path") == path).groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("issues"))
    listed = F.transform(F.coalesce("issues", F.array().cast(found.schema["issues"].dataType)), lambda i: F.struct(
        i.rule_id.alias("rule_id"), i.severity.alias("severity"), i.line.alias("line"), i.message.alias("message"),
        i.snippet.alias("snippet")))
    return stats.join(found, "path", "left").select("path", "stats", listed.alias("issues"))


def top_risk_files(profile: DataFrame, limit: int = 20) -> DataFrame:
    rows = rollups.top_files(profile, limit)
    return rows.withColumn("risk_score", F.expr(round_half_even("risk_score", 1)))


def complexity_totals(profile: DataFrame) -> DataFrame:
    worst = F.col("max_complexity")
    return profile.agg(F.coalesce(F.sum("functions"), F.lit(0)).alias("functions"),
                       F.count_if(worst > 0).alias("files_with_complexity"),
                       F.count_if(worst > 10).alias("high_complexity_files"),
                       F.coalesce(F.max(worst), F.lit(0)).alias("max_complexity"))


def complexity_files(profile: DataFrame, limit: int = 50) -> DataFrame:
    rows = profile.where("max_complexity > 0").orderBy(F.desc("max_complexity"), F.desc("issue_count"), "path").limit(limit)
    return rows.select("path", "functions", "max_complexity",
                       _average(), "code_lines")


def complexity_histogram(profile: DataFrame) -> DataFrame:
    """``(bucket, files)`` for files with complexity, all four buckets."""
    worst = F.col("max_complexity")
    buckets = {"1-5": worst.between(1, 5), "6-10": worst.between(6, 10), "11-20": worst.between(11, 20), "20+": worst > 20}
    counted = profile.agg(*[F.count_if(test).alias(name) for name, test in buckets.items()])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("bucket"), F.col(f"`{name}`").alias("files")) for name in buckets])))


def lines_vs_functions(profile: DataFrame, limit: int = 50) -> DataFrame:
    rows = profile.where("code_lines > 0").orderBy(F.desc("issue_count"), "path").limit(limit)
    return rows.select("path", "code_lines", "functions", "issue_count", "max_complexity")


def issue_density(profile: DataFrame, limit: int = 15) -> DataFrame:
    """Issues per 1000 code lines of files with more than 10 code lines, densest first."""
    density = F.col("issue_count") / F.col("code_lines") * 1000
    level = F.when(density > 20, "high").when(density > 10, "medium").otherwise("low")
    rows = profile.where("code_lines > 10").select(
        "path", F.floor(density + 0.5).cast("bigint").alias("density"), level.alias("level"), "issue_count")
    return rows.orderBy(F.desc("density"), F.desc("issue_count"), "path").limit(limit).select("path", "density", "level")


def top_issue_files(profile: DataFrame, limit: int = 10) -> DataFrame:
    """Files with most issues, with a class by count."""
    n = F.col("issue_count")
    level = F.when(n > 5, "high").when(n > 2, "medium").when(n > 1, "low").otherwise("single")
    rows = profile.where("issue_count > 0").orderBy(F.desc("issue_count"), "path").limit(limit)
    return rows.select("path", "issue_count", level.alias("level"))
