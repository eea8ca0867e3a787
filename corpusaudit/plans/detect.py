"""The detection plan: one scan of the corpus, one narrow stage, all rules.

    files -> file facts (structure facts, line statistics, file hits; all in the file's row)
          -> posexplode(lines) -> one array of nullable finding codes per line -> explode -> not null

The first line of a file also carries the file's own hits (as negative indexes into the file-hit
array) and one mark 0 that says "this file was seen". So the same stream gives the issue list (mark
<> 0) and, if it is stored, the file profile that also knows clean files. No text leaves the stage: what is
shuffled later is one short row per issue. A profile by itself folds the findings in the file's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import linestats, text
from corpusaudit.operators import catalogue, custom, file_rules, line_rules, pynodes
from corpusaudit.operators.catalogue import RULES
from corpusaudit.sources import tables

STATS = ["language", "lines", "blank_lines", "comment_lines", "code_lines", "functions", "classes",
         "max_complexity", "avg_complexity"]

ISSUE_COLUMNS = ["rule_id", "rule_name", "category", "severity", "message", "path", "line", "column", "snippet",
                 "suggestion", "confidence", "score", "rule_ord"]


def line_table(files: DataFrame) -> DataFrame:
    """``(path, language, line_no, line, stripped)``, numbered from 1."""
    rows = files.selectExpr("path", f"{text.language('path')} AS language",
                            f"posexplode({text.split_lines('content')}) AS (pos, line)")
    return rows.selectExpr("path", "language", "pos + 1 AS line_no", "line", f"{text.strip('line')} AS stripped")


def file_statistics(files: DataFrame) -> DataFrame:
    """``(path, STATS)``: everything about a file that does not depend on rules, computed in its row."""
    return _with_statistics(_with_nodes(files)).select("path", *STATS)


def _with_nodes(files: DataFrame) -> DataFrame:
    return tables.with_language(files).withColumn("nodes", pynodes.facts(F.col("language"), F.col("content")))


def _with_statistics(base: DataFrame) -> DataFrame:
    def defined(kind, counted):
        in_nodes = f"coalesce(size(filter(nodes, n -> n.kind = '{kind}')), 0)"
        return f"IF(language = 'python', {in_nodes}, {counted})"

    last = "transform(filter(nodes, n -> n.kind = 'function' AND n.last_of_name), n -> n.complexity)"
    counted = base.selectExpr(
        "*", f"{linestats.line_classes('language', 'content')} AS kinds",
        f"size({text.split_lines(linestats.body('content'))}) AS lines",
        f"{defined('function', linestats.count_functions('language', 'content'))} AS functions",
        f"{defined('class', linestats.count_classes('language', 'content'))} AS classes",
        f"coalesce({last}, CAST(array() AS ARRAY<INT>)) AS complexities")
    return counted.selectExpr(
        *base.columns, "lines", "functions", "classes", "kinds.blank AS blank_lines", "kinds.comment AS comment_lines",
        "kinds.code AS code_lines", "coalesce(array_max(complexities), 0) AS max_complexity",
        "IF(size(complexities) > 0, aggregate(complexities, 0, (a, x) -> a + x) / size(complexities), 0D) AS avg_complexity")


def marks(files: DataFrame, rule_ids=None, statistics: bool = False, custom_lines=()) -> DataFrame:
    """The stream of marks described above, for the given rules (all by default).

    Columns: path, language or STATS, code, line, at (the line's text), hit (null for line hits). Where no rule looks
    at lines, the stream is the file hits alone, and no text is cut into lines.
    """
    rule_ids = [r for r in RULES if rule_ids is None or r in rule_ids]
    needs_nodes = statistics or any(r in file_rules.NODE_RULES for r in rule_ids)
    needs_lines = statistics or custom_lines or any(r in line_rules.LINE_RULES for r in rule_ids)
    if not statistics and not custom_lines and rule_ids and all(RULES[r].languages for r in rule_ids):
        # before the parse: files of other languages have no findings
        files = files.where(f"{text.language('path')} IN {text.in_list(sorted({l for r in rule_ids for l in RULES[r].languages}))}")
    base = _with_nodes(files) if needs_nodes else tables.with_language(files)
    if statistics:
        base = _with_statistics(base)
    carried = STATS if statistics else ["language"]
    hits = file_rules.file_hits(rule_ids, "language", "content", text.split_lines("content"), "nodes")
    if not needs_lines:
        rows = base.selectExpr("path", *carried, f"explode({hits}) AS hit")
        return rows.selectExpr("path", *carried, "hit.code AS code", "hit.line AS line", "CAST(NULL AS STRING) AS at", "hit")
    base = base.selectExpr("path", "content", *carried, f"{hits} AS file_hits", f"{text.fold_case('content')} AS folded_content")
    maybe = line_rules.candidates(rule_ids, "language", "content", "folded_content")
    base = base.selectExpr("path", "content", *carried, "file_hits", f"{maybe} AS maybe")
    none = "CAST(array() AS ARRAY<INT>)"
    own = f"concat(array(0), IF(size(file_hits) > 0, sequence(-1, -size(file_hits), -1), {none})) AS own"
    lines = base.selectExpr("path", *carried, "file_hits", "maybe", own, f"posexplode({text.split_lines('content')}) AS (pos, at)")
    lines = lines.selectExpr("*", f"{text.fold_case('at')} AS folded")
    codes = [F.expr(line_rules.code(RULES[r], rule_ids, "maybe", "at", "folded")) for r in rule_ids if r in line_rules.LINE_RULES]
    codes += [custom.line_code(rule, entry, F.col("language"), F.col("at")) for rule, entry in custom_lines]
    # The lambda keeps this projection out of whole-stage code generation, where dozens of patterns would make
    # one method too long for the JIT compiler; on its own the projection is generated in short methods.
    tested = lines.select("path", *carried, "file_hits", "pos", "at", F.expr(f"filter(IF(pos = 0, own, {none}), m -> true)").alias("mine"),
                          (F.array(*codes) if codes else F.expr(none)).alias("codes"))
    marked = tested.select("path", *carried, "file_hits", "pos", "at", F.explode(F.concat("codes", "mine")).alias("mark"))
    marked = marked.where("mark IS NOT NULL")
    marked = marked.selectExpr("path", *carried, "CASE WHEN mark < 0 THEN get(file_hits, -mark - 1) END AS hit", "mark", "pos", "at")
    return marked.selectExpr("path", *carried, "coalesce(hit.code, mark) AS code", "coalesce(hit.line, pos + 1) AS line", "at", "hit")


def issues(files: DataFrame, rule_ids=None, custom_lines=(), custom_files=()) -> DataFrame:
    """One row per issue (``ISSUE_COLUMNS``), in no particular order."""
    rows = issues_of(marks(files, rule_ids, custom_lines=custom_lines), custom_lines)
    return rows.unionByName(own_file_issues(files, custom_files)) if custom_files else rows


def findings(files: DataFrame, custom_lines=()) -> DataFrame:
    """Issues and statistics as one narrow table to store, without the lines' text: ``ISSUE_COLUMNS`` and ``STATS``. Of each
    file there is a row without ``rule_ord`` too, which says that it was seen."""
    return issues_of(marks(files, statistics=True, custom_lines=custom_lines), custom_lines, STATS)


def issues_of(marked: DataFrame, custom_lines=(), carried=()) -> DataFrame:
    """The issues of a stream of marks, stored or not; those of file rules of one's own are not among them.

    With columns to be carried beside them, the marks of seen files stay as rows without a rule.
    """
    spark = marked.sparkSession
    if not carried:
        marked = marked.where("code <> 0")
    marked = marked.select("path", *carried, "code", "line", "at", "hit")
    kinds = catalogue.findings(spark, [entry for _, entry in custom_lines])
    joined = marked.join(F.broadcast(kinds), "code", "left" if carried else "inner")
    code, at = F.col("code"), F.col("at")
    out = {
        "message": F.expr(f"coalesce(hit.message, {line_rules.message('code', 'at')}, message)"),
        "snippet": F.expr(f"CASE WHEN hit IS NOT NULL THEN hit.snippet ELSE {line_rules.snippet('code', 'at')} END"),
        "suggestion": F.expr("coalesce(hit.suggestion, suggestion)"),
        "severity": F.col("severity"), "confidence": F.col("confidence"),
    }
    for rule, entry in custom_lines:
        given = rule.check(at)
        fields = _fields(spark, rule)
        for name in fields & out.keys():
            value = given.getField(name).cast("double" if name == "confidence" else "string")
            out[name] = F.when(code == entry.code(), F.coalesce(value, out[name])).otherwise(out[name])
    rows = joined.select("path", *carried, "line", "rule_ord", "rule_id", "rule_name", "category", F.lit(0).alias("column"),
                         *[column.alias(name) for name, column in out.items()])
    return _scored(rows, carried)


#: What every issue of a built-in rule has from its rule.
RULE_FIELDS = ("rule_id", "rule_name", "category", "confidence")


def short_issues(issues: DataFrame) -> DataFrame:
    """Issues of built-in rules without what their rule says: narrow rows for stores and sorts (see ``in_full``)."""
    return issues.selectExpr("path", "line", "rule_ord", "severity", "message", "snippet",
                             f"nullif(suggestion, {_of_rule('suggestion')}) AS own_suggestion")


def in_full(short: DataFrame) -> DataFrame:
    """The issues of ``short_issues`` in their order, as no join is made: a rule's fields are found by its number."""
    rows = short.selectExpr("*", *[f"{_of_rule(name)} AS {name}" for name in RULE_FIELDS], "0 AS column",
                            f"coalesce(own_suggestion, {_of_rule('suggestion')}) AS suggestion")
    return _scored(rows)


def _of_rule(name: str) -> str:
    values = [getattr(rule, name) for rule in RULES.values()]
    listed = ", ".join(f"{v}D" if isinstance(v, float) else text.lit(v) for v in values)
    return f"get(array({listed}), rule_ord - 1)"


def own_file_issues(files: DataFrame, custom_files) -> DataFrame:
    """The issues of all file rules of one's own, in one pass."""
    raw = custom.run_file_rules(tables.with_language(files), custom_files)
    return _scored(raw)


def _scored(rows: DataFrame, carried=()) -> DataFrame:
    return rows.withColumn("score", weight(F.col("severity")) * F.col("confidence")).select(*ISSUE_COLUMNS, *carried)


def statistics_of(marked: DataFrame) -> DataFrame:
    """``(path, STATS)`` of a stored stream of marks: a file's mark 0 carries them."""
    return marked.where("code = 0").select("path", *STATS)


def weight(severity: Column) -> Column:
    out = None
    for name, points in dims.SEVERITY_WEIGHT.items():
        out = F.when(severity == name, points) if out is None else out.when(severity == name, points)
    return out


def _fields(spark, rule) -> set[str]:
    return set(spark.range(0).select(rule.check(F.lit("")).alias("c")).schema["c"].dataType.names)


SEVERITY_COUNTS = {name: f"n_{name}" for name in dims.SEVERITY_ORDER}
CATEGORY_COUNTS = {name: f"n_{name}" for name in dims.CATEGORIES}


def profile(files: DataFrame) -> DataFrame:
    """One row per file, clean files included: statistics, issue counts by severity and category, risk score.

    The findings of all lines are an array in the file's row and are folded there: one scan, no shuffle.
    """
    rule_ids = list(RULES)
    base = _with_statistics(_with_nodes(files))
    hits = file_rules.file_hits(rule_ids, "language", "content", text.split_lines("content"), "nodes")
    base = base.selectExpr("path", "content", *STATS, f"transform({hits}, h -> h.code) AS file_codes",
                           f"{text.fold_case('content')} AS folded_content")
    maybe = line_rules.candidates(rule_ids, "language", "content", "folded_content")
    # Folding keeps line ends, so each line's folded text is the part at its place of the folded whole, and is made once.
    base = base.selectExpr("path", *STATS, "file_codes", f"{maybe} AS maybe", f"{text.split_lines('content')} AS text_lines",
                           f"{text.split_lines('folded_content')} AS folded_lines")
    found = [line_rules.codes_of_file(RULES[r], rule_ids, "maybe", "text_lines", "folded_lines") for r in rule_ids if r in line_rules.LINE_RULES]
    codes = f"concat(file_codes, {', '.join(found)})"
    # The codes come out of a generator: a condition on counts or score stays above it, so no text is tested twice.
    return base.selectExpr("path", *STATS, f"explode(array({codes})) AS codes").selectExpr("path", *STATS, *_folds("codes"))


def _folds(codes: str) -> list[str]:
    """Issue counts and score of an array of finding codes, by the catalogue's own values."""
    found = [(rule.code(variant), rule, f) for rule in RULES.values() for variant, f in enumerate(rule.findings, 1)]

    def counted(name, wanted):
        own = [str(code) for code, rule, finding in found if wanted(rule, finding)]
        return f"size(filter({codes}, c -> c IN ({', '.join(own)}))) AS {name}" if own else f"0 AS {name}"

    out = [f"size({codes}) AS issue_count"]
    out += [counted(name, lambda rule, f, s=s: f.severity == s) for s, name in SEVERITY_COUNTS.items()]
    out += [counted(name, lambda rule, f, k=k: rule.category == k) for k, name in CATEGORY_COUNTS.items()]
    points = " ".join(f"WHEN {code} THEN {dims.SEVERITY_WEIGHT[f.severity]} * {rule.confidence}D" for code, rule, f in found)
    out.append(f"round(aggregate({codes}, 0D, (a, c) -> a + CASE c {points} END), 6) AS score")
    return [f"CAST({x.rpartition(' AS ')[0]} AS BIGINT) AS {x.rpartition(' AS ')[2]}" if not x.endswith("score") else x for x in out]


def profile_of(statistics: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """The same table from file statistics and any issue table (stored, filtered, or with user rules)."""
    marked = statistics.select("path", *STATS)
    counts = issue_rows.groupBy("path").agg(*_counts(F.lit(True)))
    names = [c for c in counts.columns if c != "path"]
    joined = marked.join(counts.withColumnRenamed("score", "total"), "path", "left")
    return joined.select("path", *STATS, *[F.coalesce("total" if n == "score" else n, F.lit(0)).alias(n) for n in names])


def _counts(is_issue: Column) -> list[Column]:
    out = [F.count_if(is_issue).alias("issue_count")]
    out += [F.count_if(F.col("severity") == s).alias(name) for s, name in SEVERITY_COUNTS.items()]
    out += [F.count_if(F.col("category") == c).alias(name) for c, name in CATEGORY_COUNTS.items()]
    out.append(F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6).alias("score"))
    return out
