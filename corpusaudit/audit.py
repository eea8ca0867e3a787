"""Entry points: audit a corpus table or a directory tree."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusaudit.operators import catalogue, custom, duplicates
from corpusaudit.operators.duplicates import TOP_GROUPS
from corpusaudit.plans import debt, detect, reports, rollups
from corpusaudit.sinks import scratch, writers
from corpusaudit.sources import filters, tree

#: Rows of a result that one nested document may hold.
DOCUMENT_ROWS = 500_000


@dataclass(frozen=True)
class Audit:
    """A corpus and the lazy tables that an audit gives for it.

    What is asked of the duplicate blocks comes from one stored pass over the text, made at the first such question.
    """

    files: DataFrame
    issues: DataFrame
    profile: DataFrame
    blocks: duplicates.Blocks
    rules: DataFrame
    min_severity: str = "info"
    min_lines: int = duplicates.MIN_LINES
    line_rules: tuple = ()
    file_rules: tuple = ()
    target: str = ""
    stored_duplicates: DataFrame | None = None

    @property
    def duplicates(self) -> DataFrame:
        return self.blocks.corpus_groups() if self.stored_duplicates is None else self.stored_duplicates

    @property
    def duplicate_count(self) -> DataFrame:
        """One row: the number of duplicate blocks (of a corpus of one file too, which the debt totals leave out)."""
        if self.stored_duplicates is None:
            return duplicates.count_groups(self.files, self.min_lines, check_files=False)
        return self.stored_duplicates.agg(F.count("*").alias("duplicate_blocks"))

    # roll-ups
    def by_severity(self) -> DataFrame:
        return rollups.count_by_severity(self.issues)

    def by_category(self) -> DataFrame:
        return rollups.count_by_category(self.issues)

    def by_rule(self) -> DataFrame:
        return rollups.count_by_rule(self.issues)

    def languages(self) -> DataFrame:
        return rollups.count_by_language(self.files)

    def totals(self) -> DataFrame:
        return debt.totals(self.profile, self.duplicate_count, self.min_severity, check_files=True)

    def tech_debt(self) -> DataFrame:
        return debt.tech_debt(self.totals())

    def headline(self, elapsed: float = 0.0) -> DataFrame:
        return reports.headline(self.totals(), self.target, elapsed)

    def summary(self) -> DataFrame:
        return reports.summary(self.totals(), self.profile, self.issues)

    def file_stats(self) -> DataFrame:
        return rollups.file_statistics(self.profile)

    def top_duplicates(self, limit: int = TOP_GROUPS) -> DataFrame:
        """The most frequent duplicate blocks with their normalised lines."""
        return duplicates.ranked(duplicates.with_lines(self.files, duplicates.ranked(self.duplicates, limit)))

    def duplicate_places(self, limit: int | None = None) -> DataFrame:
        """Every place of all blocks, or of the ``limit`` most frequent ones."""
        chosen = self.duplicates if limit is None else duplicates.ranked(self.duplicates, limit)
        return self.blocks.occurrences(chosen)

    def listed_issues(self) -> DataFrame:
        """The issue list after the severity filter; counts and profiles stay unfiltered."""
        return reports.min_severity(self.issues, self.min_severity)

    def of_file(self, path: str) -> Audit:
        """The audit of one file: only its text is read, parsed and matched, unless issues are stored."""
        return self.narrowed(F.col("path") == path)

    def narrowed(self, paths: Column) -> Audit:
        """The audit of the files that a condition on ``path`` names, which is tested before detection."""
        return audit(self.files.where(paths), self.line_rules, self.file_rules, self.min_severity, self.min_lines)

    # storing
    def checkpoint(self) -> Audit:
        """Computes issues, profiles and duplicate groups once, in the cluster's checkpoint folder."""
        return self._stored(lambda name, table: writers.checkpointed(table))

    def write_tables(self, folder: str) -> Audit:
        """Stores the result tables as Parquet; the audit that comes back reads them. Call again to refresh.

        Each call writes a new version, which ``writers.read_tables`` finds once all of it is there; who reads
        an earlier one is not disturbed.
        """
        version = writers.Version(self.files.sparkSession, folder)
        done = self._stored(version.write)
        version.commit()
        return done

    def _stored(self, store: Callable[[str, DataFrame], DataFrame]) -> Audit:
        """All rules look at the corpus once: issues and profiles come from the stored marks."""
        lines, whole = _numbered(self.line_rules, self.file_rules)
        marked = store("marks", detect.marks(self.files, statistics=True, custom_lines=lines))
        found = detect.issues_of(marked, lines)
        if whole:
            found = found.unionByName(detect.own_file_issues(self.files, whole))
        found = store("issues", found)
        by_file = store("profile", detect.profile_of(detect.statistics_of(marked), found))
        return replace(self, issues=found, profile=by_file, stored_duplicates=store("duplicates", self.duplicates))

    def write_json(self, folder: str, elapsed: float = 0.0, compression: str | None = None) -> dict[str, StructType]:
        """The full report as one folder of JSON lines per part, from tables that are computed once; gives the parts' schemas.

        Rows repeat much, and take a small part of the disk with ``compression="gzip"``. What is stored or shuffled on the
        way is deleted when no other part needs it.
        """
        lines, whole = _numbered(self.line_rules, self.file_rules)
        asked = "by_file" in vars(self.blocks)  # then the stored blocks serve further questions too
        blocks = self.blocks if asked else duplicates.Blocks(self.files, self.min_lines)
        with scratch.freed(self.files.sparkSession):
            found = scratch.stored(detect.findings(self.files, lines), "findings")
            of_rules = [scratch.stored(detect.own_file_issues(self.files, whole), "issues")] if whole else []
            issues = found.where("rule_ord IS NOT NULL").select(*detect.ISSUE_COLUMNS)
            for rows in of_rules:
                issues = issues.unionByName(rows)
            profile = scratch.stored(detect.profile_of(found.where("rule_ord IS NULL"), issues), "profile")
            groups = scratch.stored(replace(self, blocks=blocks).duplicates, "duplicates")
            done = replace(self, issues=issues, profile=profile, blocks=blocks, stored_duplicates=groups)
            summary = done.headline(elapsed).select("target", "files_scanned", "files_with_issues", "total_issues", "elapsed")
            schemas = writers.write_json({
                "summary": summary,
                "issues_by_severity": done.by_severity(), "issues_by_category": done.by_category(),
                "issues_by_rule": done.by_rule(), "tech_debt": done.tech_debt(), "languages": done.languages(),
                "files": writers.full_files(done.profile), "issues": writers.full_issues(done.listed_issues()),
            }, folder, compression)
            for table in (found, *of_rules, profile):
                scratch.discard(table)
            schemas |= writers.write_json({
                "duplicates": duplicates.with_lines(duplicates.first_files(done.files, groups), groups),
                "duplicate_places": blocks.occurrences(groups, duplicates.KEYS_SENT),
            }, folder, compression)
            for table in (groups, *(() if asked else (blocks.numbered, blocks.by_file))):
                scratch.discard(table)
        return schemas

    def document(self, elapsed: float = 0.0, most: int = DOCUMENT_ROWS) -> DataFrame:
        """The full report as one nested row, for results of at most ``most`` files, issues and duplicate places together;
        larger ones are refused, as a row has to fit in one task (see ``write_json``)."""
        done = self.checkpoint()
        rows = sum(table.agg(count).first()[0] or 0 for table, count in (
            (done.profile, F.count("*")), (done.listed_issues(), F.count("*")), (done.duplicates, F.sum("n_occ"))))
        if rows > most:
            raise ValueError(f"{rows} rows are too many for one document (at most {most}); write_json writes rows")
        blocks = duplicates.with_lines(done.files, done.duplicates)
        return writers.document(done.headline(elapsed), done.tech_debt(), {
            "issues_by_severity": done.by_severity(), "issues_by_category": done.by_category(),
            "issues_by_rule": done.by_rule(), "languages": done.languages(),
        }, writers.full_files(done.profile), done.listed_issues(), blocks, done.duplicate_places())

    def write_document(self, folder: str, elapsed: float = 0.0, most: int = DOCUMENT_ROWS) -> None:
        """The nested report as one JSON object in one file."""
        whole = self.document(elapsed, most)
        whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).coalesce(1).write.mode("overwrite").text(folder)

    def write_issues_json(self, folder: str) -> None:
        """The short report: a three-figure summary and slim issue rows."""
        writers.write_json({"summary": self.headline().select("files_scanned", "total_issues", "quality_score"),
                            "issues": writers.slim_issues(self.listed_issues())}, folder)


def _numbered(line_rules, file_rules) -> tuple[list, list]:
    """The rules of one's own with their catalogue entries."""
    entries = custom.numbered([*line_rules, *file_rules])
    return list(zip(line_rules, entries)), list(zip(file_rules, entries[len(line_rules):]))


def audit(files: DataFrame, line_rules: Iterable[custom.LineRule] = (), file_rules: Iterable[custom.FileRule] = (),
          min_severity: str = "info", min_lines: int = duplicates.MIN_LINES) -> Audit:
    """Audits a ``(path, content)`` corpus with the built-in rules and any rules of your own."""
    line_rules, file_rules = list(line_rules), list(file_rules)
    lines, whole = _numbered(line_rules, file_rules)
    entries = [entry for _, entry in [*lines, *whole]]
    issues = detect.issues(files, custom_lines=lines, custom_files=whole)
    if entries:
        profile = detect.profile_of(detect.file_statistics(files), issues)
    else:
        profile = detect.profile(files)
    return Audit(files, issues, profile, duplicates.Blocks(files, min_lines),
                 catalogue.rules_catalogue(files.sparkSession, extra=entries), min_severity, min_lines,
                 tuple(line_rules), tuple(file_rules))


def scan_path(spark: SparkSession, path: str, extensions=None, skip_dirs=None, max_size: int | None = None,
              exclude_patterns=None, **options) -> Audit:
    """Audits a directory tree (or one file)."""
    files = tree.read_tree(spark, path, extensions, skip_dirs, max_size, exclude_patterns)
    return replace(audit(files, **options), target=path)


def scan_table(files: DataFrame, root: str = "", extensions=None, skip_dirs=None, max_size: int | None = None,
               exclude_patterns=(), **options) -> Audit:
    """Audits the scannable files of a ``(path, content)`` table."""
    size = filters.dims.MAX_FILE_SIZE if max_size is None else max_size
    kept = filters.scannable(files, extensions, skip_dirs, size, exclude_patterns, root)
    return audit(kept, **options)


