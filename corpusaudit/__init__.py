"""Audit of large corpora of code and text as Spark jobs."""

from corpusaudit.audit import Audit, audit, scan_path, scan_table
from corpusaudit.operators.custom import FileRule, LineRule

__all__ = ["Audit", "FileRule", "LineRule", "audit", "scan_path", "scan_table"]
