"""Scalar text expressions: paths, languages, decoding, trimming, line normalisation.

Expressions are written as Spark SQL text: each function takes the SQL of its arguments (mostly a column
name) and gives SQL for ``F.expr`` or ``selectExpr``. A whole rule is then one call into the JVM instead
of one call per operator.
"""

from __future__ import annotations

from corpusaudit import dims
from corpusaudit.functions.patterns import (DIGIT, OTHER_SPACE_IN_LINE, SPACE_IN_LINE, WHITESPACE_CHARS, WORD,
                                            compile_pattern)

SNIPPET_LENGTH = 120


def lit(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def case_of(subject: str, groups: dict[str, list[str]], default: str = "NULL") -> str:
    """CASE that gives the key of the group whose list holds the subject."""
    branches = " ".join(f"WHEN {subject} IN {in_list(values)} THEN {lit(key)}" for key, values in groups.items())
    return f"CASE {branches} ELSE {default} END"


_BLANKS = lit(WHITESPACE_CHARS)


def strip(x: str) -> str:
    return f"trim(BOTH {_BLANKS} FROM {x})"


def strip_left(x: str) -> str:
    return f"trim(LEADING {_BLANKS} FROM {x})"


def strip_right(x: str) -> str:
    return f"trim(TRAILING {_BLANKS} FROM {x})"


def snippet(line: str) -> str:
    """Trimmed line, cut to 120 characters."""
    return f"substring({strip(line)}, 1, {SNIPPET_LENGTH})"


def extension(path: str) -> str:
    """Lower-cased extension with its dot; a name that starts with its only dot has none."""
    return f"lower(regexp_extract({path}, {lit(r'[^./][^/]*(\.[^./]*)$')}, 1))"


def language(path: str) -> str:
    """Language of a path by its extension, else ``unknown``."""
    return language_of_extension(extension(path))


def language_of_extension(ext: str) -> str:
    pairs = ", ".join(f"{lit(e)}, {lit(name)}" for e, name in dims.EXTENSION_LANGUAGE.items())
    return f"coalesce(try_element_at(map({pairs}), {ext}), 'unknown')"


def relative_path(path: str, root: str) -> str:
    """Path below ``root`` with forward slashes."""
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    slashed = f"translate({path}, {lit(chr(92))}, '/')"
    return f"CASE WHEN startswith({slashed}, {lit(prefix)}) THEN substring({slashed}, {len(prefix) + 1}) ELSE {slashed} END"


def decode(content: str) -> str:
    """Bytes to text: UTF-8 when valid, else Latin-1; CR LF and lone CR become LF."""
    as_text = f"CAST({content} AS STRING)"
    readable = f"CASE WHEN is_valid_utf8({as_text}) THEN {as_text} ELSE decode({content}, 'ISO-8859-1') END"
    return unify_newlines(readable)


def unify_newlines(x: str) -> str:
    return f"replace(replace({x}, '\\r\\n', '\\n'), '\\r', '\\n')"


def split_lines(content: str) -> str:
    """Lines of a text; a trailing newline gives one empty last line."""
    return f"split({content}, '\\n', -1)"


def _replaced(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)})"


def normalize(content: str) -> str:
    """Text with every line normalised for duplicate search.

    Works on whole texts (each step stays inside its line), so that no per-line call is needed. White
    space collapses first, which commutes with the cuts and makes the trims one blank wide; single
    blanks, the bulk of it, are left alone. A digit is sought before what stands ahead of it is looked at.
    """
    x = _replaced(content, f"(?: [{SPACE_IN_LINE}]|[{OTHER_SPACE_IN_LINE}])[{SPACE_IN_LINE}]*", " ")
    x = _replaced(x, "(?d)#.*", "")
    x = _replaced(x, "(?d)//.*", "")
    x = _replaced(x, '"[^"\n]*"', '"STR"')
    x = _replaced(x, "'[^'\n]*'", "'STR'")
    x = _replaced(x, f"(?=[{DIGIT}])(?<![{WORD}])[{DIGIT}]+(?![{WORD}])", "NUM")
    return _replaced(x, "(?dm)^ | $", "")


def snake_case(name: str) -> str:
    return f"lower(regexp_replace({name}, '([A-Z])', '_$1'))"


def matches(x: str, pattern: str) -> str:
    return f"{x} RLIKE {lit(compile_pattern(pattern))}"


def fold_case(line: str) -> str:
    """Lower-cased text in which an ASCII literal without ``i`` is found whenever ``(?i)literal`` matches.

    Lower-casing covers every letter pair but the long s (U+017F).
    """
    return f"lower(replace({line}, '\u017f', 's'))"


def round_half_even(x: str, digits: int) -> str:
    """Rounding as Python does it: of the exact binary value, ties to even (``round`` looks at the printed digits).

    The rounding error of ``x * 10^digits`` is recovered exactly by splitting x into two halves.
    """
    scale = f"{10 ** digits}D"
    x = f"CAST({x} AS DOUBLE)"
    product, wide = f"({x} * {scale})", f"({x} * 134217729D)"
    high = f"({wide} - ({wide} - {x}))"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    below = f"floor({product})"
    over = f"(({product} - {below} - 0.5D) + {error})"
    return f"(({below} + CASE WHEN {over} > 0 THEN 1 WHEN {over} < 0 THEN 0 ELSE {below} % 2 END) / {scale})"
