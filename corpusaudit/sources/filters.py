"""Corpus filters as DataFrame predicates on the path and the size of a file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import text


def has_extension(path: str, extensions: Iterable[str] = dims.SCAN_EXTENSIONS) -> Column:
    return F.expr(f"{text.extension(path)} IN {text.in_list(extensions)}")


def in_skipped_dir(relative_path: str, skip_dirs: Iterable[str] = dims.SKIP_DIRS) -> Column:
    """True when a directory below the root is a skipped name or starts with a dot."""
    names = "|".join(_quote(name) for name in skip_dirs)
    return F.col(relative_path).rlike(rf"(?:^|/)(?:\.[^/]*|{names})/")


def fits_size(content: str, max_size: int = dims.MAX_FILE_SIZE) -> Column:
    return F.octet_length(content) <= max_size


def is_excluded(absolute_path: Column | str, patterns: Iterable[str]) -> Column:
    """True when one of the given substrings occurs in the forward-slash absolute path."""
    slashed = F.replace(absolute_path, F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for pattern in patterns:
        out = out | F.contains(slashed, F.lit(pattern))
    return out


def scannable(files: DataFrame, extensions: Iterable[str] | None = None, skip_dirs: Iterable[str] | None = None,
              max_size: int = dims.MAX_FILE_SIZE, exclude_patterns: Iterable[str] = (), root: str = "") -> DataFrame:
    """The files of a ``(path, content)`` table that a scan takes in."""
    keep = has_extension("path", extensions or dims.SCAN_EXTENSIONS)
    keep = keep & ~in_skipped_dir("path", skip_dirs or dims.SKIP_DIRS) & fits_size("content", max_size)
    exclude_patterns = list(exclude_patterns)
    if exclude_patterns:
        keep = keep & ~is_excluded(F.concat(F.lit(root), "path"), exclude_patterns)
    return files.where(keep)


def _quote(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in name)
