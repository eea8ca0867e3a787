"""Registered queries: every operator over whole tables.

The corpus is the code corpus plus the ``documents``, ``pages`` and ``conversations`` tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit import LineRule, FileRule, audit as run_audit, dims
from corpusaudit.functions import linestats, text
from corpusaudit.operators import catalogue, duplicates, pynodes
from corpusaudit.plans import debt, detect, reports, rollups
from corpusaudit.sinks import scratch, writers
from corpusaudit.sources import filters, tables, tree, tree_source
from workload.code_corpus import code_files, splits

EXCLUDED = ["src1/", "ts/5", "tests/"]
ROOT = "/data/checkout/"
DETAIL_PATH = "src2/f22.py"


def read(spark, sf_dir, name, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    table = read(spark, sf_dir, "documents", "doc_id bigint, source string, text string")
    return tables.corpus(table, F.concat("source", F.lit("/"), "doc_id", F.lit(".md")), F.col("text"), splits(spark))


def pages(spark, sf_dir) -> DataFrame:
    table = read(spark, sf_dir, "pages", "page_id bigint, html string")
    return tables.corpus(table, F.concat(F.lit("pages/"), "page_id", F.lit(".html")), F.col("html"), splits(spark))


def conversations(spark, sf_dir) -> DataFrame:
    table = read(spark, sf_dir, "conversations", "conv_id bigint, turn bigint, text string")
    path = F.concat(F.lit("conversations/"), "conv_id", F.lit("/"), "turn", F.lit(".md"))
    return tables.corpus(table, path, F.col("text"), splits(spark))


def raw_corpus(spark, sf_dir) -> DataFrame:
    parts = [f(spark, sf_dir) for f in (code_files, documents, pages, conversations)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def corpus(spark, sf_dir) -> DataFrame:
    return filters.scannable(raw_corpus(spark, sf_dir))


def issues(spark, sf_dir, rule_ids=None) -> DataFrame:
    return detect.issues(corpus(spark, sf_dir), rule_ids)


def sorted_issues(spark, sf_dir, order) -> DataFrame:
    """Computed once, as a range-partitioned sort reads its input twice; what a rule says is added behind the sort."""
    return detect.in_full(order(scratch.stored(detect.short_issues(issues(spark, sf_dir)), "issues")))


def one_file(spark, sf_dir) -> DataFrame:
    """The corpus cut down to one path before detection."""
    return corpus(spark, sf_dir).where(F.col("path") == DETAIL_PATH)


def profile(spark, sf_dir) -> DataFrame:
    return detect.profile(corpus(spark, sf_dir))


def stored_profile(spark, sf_dir) -> DataFrame:
    """Computed once, for readers that look at it twice, as a range-partitioned sort does."""
    return writers.checkpointed(profile(spark, sf_dir))


def totals(spark, sf_dir, min_severity="info") -> DataFrame:
    files = corpus(spark, sf_dir)
    return debt.totals(detect.profile(files), duplicates.count_groups(files, check_files=False), min_severity, check_files=True)


# --- sources and filters ----------------------------------------------------------------------

def _written_tree(spark, sf_dir) -> str:
    """The code corpus as a tree of files in the shared folder."""
    folder = scratch.fresh_path(spark, "corpus")

    def write(batches):
        files, root = tree.opened(folder)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                files.create_dir(os.path.dirname(f"{root}/{path}"))
                with files.open_output_stream(f"{root}/{path}") as stream:
                    stream.write(content.encode())
            yield batch[["path"]]

    code_files(spark, sf_dir).mapInPandas(write, "path string").count()
    return folder


def src_files(spark, sf_dir):
    """Writes the code corpus as a tree of files, then reads the tree."""
    return tree.read_tree(spark, _written_tree(spark, sf_dir)).select("path", F.md5(F.col("content")).alias("content_md5"))


def src_tree_format(spark, sf_dir):
    """One folder of the same tree through the data source, its files of 40 bytes and more."""
    files = tree_source.scan(spark, _written_tree(spark, sf_dir), starts="src2/", least=40)
    return files.select("path", "size", F.md5(F.expr(text.decode("content"))).alias("content_md5"))


def src_table(spark, sf_dir):
    return tables.describe(raw_corpus(spark, sf_dir)).select(
        "path", "n_bytes", "ext", "language", F.md5(F.col("content")).alias("content_md5"))


def filter_extension(spark, sf_dir):
    return raw_corpus(spark, sf_dir).where(filters.has_extension("path")).select("path")


def filter_skip_dirs(spark, sf_dir):
    return raw_corpus(spark, sf_dir).where(~filters.in_skipped_dir("path")).select("path")


def filter_max_size(spark, sf_dir):
    """With a limit of 4 KiB, as no text of the corpus reaches 1 MiB."""
    return raw_corpus(spark, sf_dir).where(filters.fits_size("content", 4096)).select("path")


def filter_exclude(spark, sf_dir):
    kept = ~filters.is_excluded(F.concat(F.lit(ROOT), "path"), EXCLUDED)
    return raw_corpus(spark, sf_dir).where(kept).select("path")


def decode_text(spark, sf_dir):
    """Texts as bytes, in UTF-8 or Latin-1 by key and with three kinds of line ends."""
    rows = read(spark, sf_dir, "documents", "doc_id bigint, text string")
    k = F.col("doc_id")
    latin = F.regexp_replace("text", "[^\\x{0}-\\x{ff}]", "?")
    shown = F.when(k % 2 == 0, F.col("text")).otherwise(latin)
    ended = F.when(k % 3 == 0, F.replace(shown, F.lit("\n"), F.lit("\r\n"))).when(
        k % 3 == 1, F.replace(shown, F.lit("\n"), F.lit("\r"))).otherwise(shown)
    content = F.when(k % 2 == 0, F.encode(ended, "UTF-8")).otherwise(F.encode(ended, "ISO-8859-1"))
    decoded = rows.select("doc_id", content.alias("content")).selectExpr("doc_id", f"{text.decode('content')} AS text")
    return decoded.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def rel_path(spark, sf_dir):
    full = raw_corpus(spark, sf_dir).select(F.concat(F.lit(ROOT), F.translate("path", "/", "\\")).alias("full"))
    return full.selectExpr(f"{text.relative_path('full', ROOT)} AS path")


# --- rows and scalars -------------------------------------------------------------------------

def explode_lines(spark, sf_dir):
    return detect.line_table(corpus(spark, sf_dir))


def detect_language(spark, sf_dir):
    return raw_corpus(spark, sf_dir).selectExpr("path", f"{text.language('path')} AS language")


def strip_snippet(spark, sf_dir):
    rows = detect.line_table(corpus(spark, sf_dir))
    return rows.selectExpr("path", "line_no", f"{text.snippet('line')} AS snippet")


def issue_score(spark, sf_dir):
    return issues(spark, sf_dir).select("rule_id", "path", "line", "severity", "confidence",
                                        F.round("score", 6).alias("score"))


def comment_ratio(spark, sf_dir):
    stats = detect.file_statistics(corpus(spark, sf_dir))
    ratio = F.when(F.col("code_lines") == 0, 0.0).otherwise(F.col("comment_lines") / F.col("code_lines"))
    return stats.select("path", ratio.alias("comment_ratio"))


def normalize_line(spark, sf_dir):
    rows = corpus(spark, sf_dir).selectExpr("path", f"posexplode({text.split_lines(text.normalize('content'))}) AS (pos, normal)")
    return rows.selectExpr("path", "pos + 1 AS line_no", "normal")


def snake_case(spark, sf_dir):
    nodes = pynodes.nodes(_python(spark, sf_dir)).where("kind = 'function'")
    return nodes.selectExpr("path", "lineno", "name", f"{text.snake_case('name')} AS snake")


# --- statistics -------------------------------------------------------------------------------

def _line_classes(spark, sf_dir, python: bool):
    files = tables.with_language(corpus(spark, sf_dir))
    files = files.where((F.col("language") == "python") == F.lit(python))
    counted = files.selectExpr("path", f"size({text.split_lines(linestats.body('content'))}) AS lines",
                               f"{linestats.line_classes('language', 'content')} AS k")
    return counted.selectExpr("path", "lines", "k.blank AS blank_lines", "k.comment AS comment_lines", "k.code AS code_lines")


def _counts(spark, sf_dir, count, name):
    files = tables.with_language(corpus(spark, sf_dir)).where("language <> 'python'")
    return files.selectExpr("path", "language", f"{count('language', 'content')} AS {name}")


def _python(spark, sf_dir):
    return tables.with_language(corpus(spark, sf_dir)).where("language = 'python'")


def py_counts(spark, sf_dir):
    stats = detect.file_statistics(_python(spark, sf_dir))
    return stats.select("path", "functions", "classes")


def py_complexity_stats(spark, sf_dir):
    stats = detect.file_statistics(_python(spark, sf_dir))
    return stats.select("path", "max_complexity", F.round("avg_complexity", 6).alias("avg_complexity"))


def file_stats(spark, sf_dir):
    rows = rollups.file_statistics(profile(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("avg_complexity", "comment_ratio")})


def py_nodes(spark, sf_dir):
    return pynodes.nodes(_python(spark, sf_dir)).drop("used", "last_of_name")


def py_cyclomatic(spark, sf_dir):
    rows = pynodes.nodes(_python(spark, sf_dir)).where("kind = 'function'")
    return rows.select("path", "name", "lineno", "complexity")


def py_last_by_name(spark, sf_dir):
    rows = pynodes.last_by_name(pynodes.nodes(_python(spark, sf_dir)))
    return rows.select("path", "name", "lineno", "end_lineno", "complexity")


def function_locations(spark, sf_dir):
    return pynodes.function_locations(pynodes.nodes(_python(spark, sf_dir)))


def import_names(spark, sf_dir):
    return pynodes.import_names(pynodes.nodes(_python(spark, sf_dir)))


# --- rules ------------------------------------------------------------------------------------

ISSUE_FIELDS = ["rule_id", "path", "line", "severity", "message", "snippet", "suggestion", "confidence"]


def _rule(rule_id):
    return lambda spark, sf_dir: issues(spark, sf_dir, [rule_id]).select(*ISSUE_FIELDS)


def issues_all(spark, sf_dir):
    return issues(spark, sf_dir).select("rule_id", "rule_name", "category", *ISSUE_FIELDS[1:])


# --- duplicates -------------------------------------------------------------------------------

def dup_windows(spark, sf_dir):
    rows = duplicates.windows(corpus(spark, sf_dir))
    return rows.select("path", "start_line", F.array_join("block", "\n").alias("block"))


def dup_low_info(spark, sf_dir):
    rows = duplicates.windows(corpus(spark, sf_dir)).where(duplicates.is_informative("block"))
    return rows.select("path", "start_line")


def dup_hash(spark, sf_dir):
    return duplicates.hashed_windows(corpus(spark, sf_dir))


def dup_groups(spark, sf_dir):
    return duplicates.groups(corpus(spark, sf_dir))


def dup_ranked(spark, sf_dir):
    return duplicates.ranked(duplicates.groups(corpus(spark, sf_dir)))


def dup_corpus(spark, sf_dir):
    """Groups under the condition that there are two files."""
    return duplicates.corpus_groups(corpus(spark, sf_dir))


def dup_stats(spark, sf_dir):
    """Over all groups, not only the first 20."""
    blocks = duplicates.Blocks(corpus(spark, sf_dir))
    found = writers.checkpointed(blocks.groups())
    return duplicates.statistics(found, blocks.occurrences(found))


def dup_top_stats(spark, sf_dir):
    """Over the 20 most frequent blocks."""
    blocks = duplicates.Blocks(corpus(spark, sf_dir))
    top = writers.checkpointed(duplicates.ranked(blocks.groups(), duplicates.TOP_GROUPS))
    return duplicates.statistics(top, blocks.occurrences(top))


def dup_occurrences(spark, sf_dir):
    blocks = duplicates.Blocks(corpus(spark, sf_dir))
    return blocks.occurrences(writers.checkpointed(blocks.groups()))


# --- roll-ups ---------------------------------------------------------------------------------

def _of_issues(f, *args, **kwargs):
    return lambda spark, sf_dir: f(issues(spark, sf_dir), *args, **kwargs)


def _of_profile(f, *args, **kwargs):
    return lambda spark, sf_dir: f(profile(spark, sf_dir), *args, **kwargs)


def _of_statistics(f):
    return lambda spark, sf_dir: f(detect.file_statistics(corpus(spark, sf_dir)))


def _of_totals(f):
    return lambda spark, sf_dir: f(totals(spark, sf_dir))


def _listed(rows):
    return rows.select(*ISSUE_FIELDS)


def count_by_language(spark, sf_dir):
    return rollups.count_by_language(corpus(spark, sf_dir))


# --- debt -------------------------------------------------------------------------------------

def debt_complexity(spark, sf_dir):
    return debt.complexity_debt(detect.file_statistics(corpus(spark, sf_dir)))


def debt_duplicates(spark, sf_dir):
    counted = duplicates.count_groups(corpus(spark, sf_dir))
    return counted.select((F.col("duplicate_blocks") * debt.DUPLICATE_MINUTES).alias("minutes"))


def _measures(*columns):
    return lambda spark, sf_dir: debt.measures(totals(spark, sf_dir)).select(*columns)


def quality_score(spark, sf_dir):
    """Unrounded and rounded."""
    return debt.measures(totals(spark, sf_dir)).select(F.round("score", 6).alias("score"), "quality_score")


def debt_breakdown(spark, sf_dir):
    return totals(spark, sf_dir).select(*debt.breakdown_columns())


def tech_debt(spark, sf_dir):
    """The nested debt row, with its map and struct taken apart for comparison."""
    row = debt.tech_debt(totals(spark, sf_dir))
    kinds = [*dims.FIX_MINUTES, "complexity", "duplicates"]
    return row.select("total_debt_minutes", "total_debt_hours", "total_debt_days", "formatted",
                      *[F.col("debt_by_severity")[k].alias(f"debt_{k}") for k in kinds],
                      "quality_score", "grade", "risk_level", "issues_per_kloc", "total_code_lines", "breakdown.*")


# --- reports ----------------------------------------------------------------------------------

def min_severity(spark, sf_dir):
    return reports.min_severity(issues(spark, sf_dir), "medium").select(*ISSUE_FIELDS)


def min_severity_totals(spark, sf_dir):
    """The debt row of a filtered scan: the total is filtered, the counts are not."""
    return debt.measures(totals(spark, sf_dir, "medium")).select(
        "total_issues", "n_info", "quality_score", "grade", "issues_per_kloc")


def rules_catalogue(spark, sf_dir):
    """The catalogue with the number of issues of each rule."""
    rules = catalogue.rules_catalogue(spark).withColumn("languages", F.array_join("languages", ","))
    counted = issues(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("issues"))
    return rules.join(counted, "rule_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))


def summary(spark, sf_dir):
    return run_audit(corpus(spark, sf_dir)).checkpoint().summary()


def q_file_detail(spark, sf_dir):
    """Statistics and issues of one path, the nested row taken apart."""
    files = one_file(spark, sf_dir)
    row = reports.file_detail(detect.profile(files), detect.issues(files), DETAIL_PATH)
    one = F.explode_outer("issues").alias("i")
    return row.select("path", "stats.*", one).select("path", "language", "lines", "code_lines", "comment_lines",
                                                     "functions", "classes", "max_complexity", "avg_complexity", "i.*")


def q_duplicates(spark, sf_dir):
    files = corpus(spark, sf_dir)
    top = duplicates.ranked(duplicates.groups(files), duplicates.TOP_GROUPS)
    rows = duplicates.with_lines(files, top)
    return rows.select("hash", F.array_join("lines", "\n").alias("lines"), "line_count", "n_occ", "first_path", "first_line")


# --- sinks and extension ----------------------------------------------------------------------

def _part(rows, section, key, value) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.concat_ws("|", *key).alias("key"), F.concat_ws("|", *value).alias("value"))


def _together(parts) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


FILE_FIELDS = ["language", "lines", "code_lines", "comment_lines", "blank_lines", "functions", "classes", "max_complexity", "issue_count"]


def sink_json(spark, sf_dir):
    """The full report, written as compressed JSON and read back: every part, as section, key and value."""
    folder = scratch.fresh_path(spark, "corpus")
    schemas = run_audit(corpus(spark, sf_dir)).write_json(folder, elapsed=1.5, compression="gzip")

    def part(name):
        return spark.read.schema(schemas[name]).json(os.path.join(folder, name))

    files = part("files").withColumn("hundredths", F.round(F.col("avg_complexity") * 100).cast("bigint"))
    return _together([
        _part(part("summary"), "summary", [F.lit("all")], ["target", "files_scanned", "files_with_issues", "total_issues", "elapsed"]),
        *[_part(part(f"issues_by_{k}"), k, [k], ["issues"]) for k in ("severity", "category", "rule")],
        _part(part("tech_debt"), "tech_debt", [F.lit("all")], ["total_debt_minutes", "formatted", "grade", "risk_level", "total_code_lines"]),
        _part(part("languages"), "language", ["language"], ["files"]),
        _part(files, "file", ["path"], [*FILE_FIELDS, "hundredths"]),
        _part(part("issues"), "issue", ["rule_id", "file", "line"], [F.md5(F.concat_ws("|", "rule_name", "category", "severity", "message", "snippet", "suggestion"))]),
        _part(part("duplicates"), "duplicate", ["hash"], ["line_count", "n_occ", "first_path", "first_line", F.md5(F.array_join("lines", "\n"))]),
        _part(part("duplicate_places"), "place", ["hash", "path", "start_line"], [F.lit("")]),
    ])


def sink_issues_json(spark, sf_dir):
    rows = writers.slim_issues(issues(spark, sf_dir))
    folder = scratch.fresh_path(spark, "corpus")
    writers.write_json({"issues": rows}, folder)
    return spark.read.schema(rows.schema).json(os.path.join(folder, "issues"))


def sink_tables(spark, sf_dir):
    """Stores the audit's tables, and gives rows of each of them as section, key and value."""
    folder = scratch.fresh_path(spark, "corpus")
    run_audit(corpus(spark, sf_dir)).write_tables(folder)
    part = writers.read_tables(spark, folder).__getitem__

    return _together([
        _part(rollups.count_by_rule(part("issues")), "rule", ["rule"], ["issues"]),
        _part(part("profile"), "file", ["path"], FILE_FIELDS),
        _part(part("duplicates"), "duplicate", ["hash"], ["line_count", "n_occ", "first_path", "first_line"]),
    ])


def custom_rule(spark, sf_dir):
    """A column rule and two file rules of one's own next to the built-in ones."""
    shouting = LineRule("USR001", "Shouting", "style", "low", "A line in capitals.", lambda line: F.when(
        line.rlike("^[A-Z]{4,}"), F.struct(F.concat(F.lit("shouts: "), F.substring(line, 1, 4)).alias("message"))))

    def many_blank(path, content):
        if content.count("\n\n") >= 2:
            yield {"message": f"{content.count(chr(10))} newlines", "line": 1, "severity": "medium", "confidence": 0.5}

    sparse = FileRule("USR002", "Sparse", "style", "info", "Empty lines.", many_blank, ("markdown", "python"))
    def many_lines(path, content):
        if content.count("\n") >= 40:
            yield {"message": f"{content.count(chr(10)) + 1} lines", "line": 2}

    long = FileRule("USR003", "Long", "complexity", "low", "Many lines.", many_lines)
    found = run_audit(corpus(spark, sf_dir), [shouting], [sparse, long]).issues
    return found.where(F.col("rule_id").startswith("USR")).select(
        "rule_id", "rule_name", "path", "line", "severity", "message", "confidence", F.round("score", 6).alias("score"))


RULE_KEYS = {rule_id.lower(): rule_id for rule_id, rule in catalogue.RULES.items() if rule.findings}

QUERIES = {
    "src_files": src_files, "src_tree_format": src_tree_format, "src_table": src_table, "filter_extension": filter_extension,
    "filter_skip_dirs": filter_skip_dirs, "filter_max_size": filter_max_size, "filter_exclude": filter_exclude,
    "decode_text": decode_text, "rel_path": rel_path,
    "explode_lines": explode_lines, "detect_language": detect_language, "strip_snippet": strip_snippet,
    "issue_score": issue_score, "comment_ratio": comment_ratio, "normalize_line": normalize_line,
    "snake_case": snake_case,
    "line_classes_generic": lambda s, d: _line_classes(s, d, False),
    "line_classes_python": lambda s, d: _line_classes(s, d, True),
    "count_functions": lambda s, d: _counts(s, d, linestats.count_functions, "functions"),
    "count_classes": lambda s, d: _counts(s, d, linestats.count_classes, "classes"),
    "py_counts": py_counts, "py_complexity_stats": py_complexity_stats, "file_stats": file_stats,
    "py_nodes": py_nodes, "py_cyclomatic": py_cyclomatic, "py_last_by_name": py_last_by_name,
    "function_locations": function_locations, "import_names": import_names,
    **{key: _rule(rule_id) for key, rule_id in RULE_KEYS.items()},
    "issues_all": issues_all,
    "dup_windows": dup_windows, "dup_low_info": dup_low_info, "dup_hash": dup_hash, "dup_groups": dup_groups,
    "dup_ranked": dup_ranked, "dup_corpus": dup_corpus, "dup_stats": dup_stats, "dup_top_stats": dup_top_stats,
    "dup_occurrences": dup_occurrences,
    "count_by_severity": _of_issues(rollups.count_by_severity),
    "count_by_category": _of_issues(rollups.count_by_category),
    "count_by_rule": _of_issues(rollups.count_by_rule), "count_by_language": count_by_language,
    "scan_totals": _of_profile(rollups.scan_totals),
    "issues_for_file": lambda s, d: _listed(rollups.issues_for_file(detect.issues(one_file(s, d)), DETAIL_PATH)),
    "top_files": _of_profile(rollups.top_files), "top_rules": _of_issues(rollups.top_rules),
    "debt_by_severity": _of_totals(debt.debt_by_severity), "debt_complexity": debt_complexity,
    "debt_duplicates": debt_duplicates,
    "debt_total": _measures("total_debt_minutes", "total_debt_hours", "total_debt_days"),
    "debt_formatted": _measures("total_debt_minutes", "formatted"),
    "issues_per_kloc": _measures("issues_per_kloc"), "quality_score": quality_score, "grade": _measures("grade"),
    "risk_level": _measures("risk_level"), "debt_breakdown": debt_breakdown, "tech_debt": tech_debt,
    "min_severity": min_severity, "min_severity_totals": min_severity_totals,
    "gate": _of_issues(reports.gate, "medium"), "rules_catalogue": rules_catalogue, "summary": summary,
    "q_stats": lambda s, d: reports.headline(totals(s, d), "corpus", 1.5),
    "q_issues": lambda s, d: _listed(reports.find_issues(
        detect.issues(corpus(s, d).where(F.contains("path", F.lit("src1")))), "high", "src1")),
    "q_files": lambda s, d: reports.file_list(stored_profile(s, d)), "q_file_detail": q_file_detail, "q_duplicates": q_duplicates,
    "q_top_files": _of_profile(reports.top_risk_files),
    "q_search": lambda s, d: _listed(reports.search(issues(s, d), "medium", "sha1 ")),
    "q_search_count": _of_issues(reports.search_count, None, "F2"),
    "q_security_view": _of_issues(reports.security_totals),
    "q_security_rules": _of_issues(reports.security_rules),
    "q_security_issues": lambda s, d: _listed(reports.security_issues(issues(s, d))),
    "q_complexity_view": _of_statistics(reports.complexity_totals),
    "q_complexity_files": _of_profile(reports.complexity_files),
    "q_complexity_hist": _of_statistics(reports.complexity_histogram),
    "q_lines_vs_functions": _of_profile(reports.lines_vs_functions),
    "q_issue_density": _of_profile(reports.issue_density),
    "q_top_issue_files": _of_profile(reports.top_issue_files),
    "q_top_issue_files_30": _of_profile(reports.top_issue_files, 30),
    "q_sorted_issues": lambda s, d: _listed(sorted_issues(s, d, reports.sorted_by_file)),
    "q_severity_sorted_issues": lambda s, d: _listed(sorted_issues(s, d, reports.sorted_by_severity)),
    "sink_json": sink_json, "sink_issues_json": sink_issues_json, "sink_tables": sink_tables,
    "custom_rule": custom_rule,
}
