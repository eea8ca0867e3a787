"""User-defined rules.

``LineRule``: a column function from a line to a nullable struct with the field ``message`` and, if
wanted, ``severity``, ``suggestion``, ``confidence``. It runs in the same pass as the built-in rules.

``FileRule``: a Python function ``(path, content) -> iterable of dicts`` (keys ``message``, ``line``,
``snippet``, ``suggestion``, ``severity``, ``confidence``, ``column``), run in Arrow batches. When it
raises, the rule is skipped for that file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.operators.catalogue import RULES, Finding, Rule

RAW_SCHEMA = ("path string, line int, column int, severity string, message string, snippet string, "
              "suggestion string, confidence double, rule_ord int, rule_id string, rule_name string, category string")


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    rule_name: str
    category: str
    severity: str
    description: str
    check: Callable[[Column], Column]
    languages: tuple[str, ...] = ()


@dataclass(frozen=True)
class FileRule:
    rule_id: str
    rule_name: str
    category: str
    severity: str
    description: str
    check: Callable[[str, str], Iterable[dict]]
    languages: tuple[str, ...] = ()


def numbered(rules) -> list[Rule]:
    """Catalogue entries for user rules, ordered after the built-in ones."""
    seen = set(RULES)
    out = []
    for i, rule in enumerate(rules, len(RULES) + 1):
        if rule.rule_id in seen:
            raise ValueError(f"rule id {rule.rule_id} is taken")
        if rule.severity not in dims.SEVERITY_WEIGHT or rule.category not in dims.CATEGORIES:
            raise ValueError(f"unknown severity or category in rule {rule.rule_id}")
        seen.add(rule.rule_id)
        out.append(Rule(rule.rule_id, rule.rule_name, rule.category, rule.severity, rule.description, "", 1.0,
                        (Finding("", rule.severity),), tuple(rule.languages), i))
    return out


def line_code(rule: LineRule, entry: Rule, language: Column, line: Column) -> Column:
    hit = F.when(rule.check(line).isNotNull(), entry.code())
    return F.when(language.isin([n.lower() for n in rule.languages]), hit) if rule.languages else hit


def run_file_rules(files: DataFrame, rules: list[tuple[FileRule, Rule]]) -> DataFrame:
    """Raw hits of file rules, with their catalogue entries, over ``(path, content, language)``: each text goes to
    Python once, if one of the rules looks at its language."""
    chosen = [({n.lower() for n in rule.languages}, rule.check, rule.severity, (entry.order, entry.rule_id, entry.rule_name, entry.category))
              for rule, entry in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "line", "column", "severity", "message", "snippet", "suggestion", "confidence",
                   "rule_ord", "rule_id", "rule_name", "category"]
        for batch in batches:
            rows = []
            for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
                for languages, check, severity, entry in chosen:
                    if languages and language not in languages:
                        continue
                    try:
                        rows += [(path, int(h.get("line", 0)), int(h.get("column", 0)), h.get("severity") or severity,
                                  h["message"], h.get("snippet", ""), h.get("suggestion", ""),
                                  float(h.get("confidence", 1.0)), *entry) for h in check(path, content)]
                    except Exception:  # a failing rule is skipped for that file
                        continue
            yield pd.DataFrame(rows, columns=columns)

    if all(languages for languages, *_ in chosen):
        files = files.where(F.col("language").isin(sorted(set().union(*(languages for languages, *_ in chosen)))))
    return files.select("path", "content", "language").mapInPandas(run, RAW_SCHEMA)
