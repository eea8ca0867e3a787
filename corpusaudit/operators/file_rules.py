"""Rules that look at a whole file or at its structure facts.

Each gives an array of hits (``HIT_TYPE``) inside the file's row, so none of them needs a shuffle.
"""

from __future__ import annotations

from corpusaudit.functions import text
from corpusaudit.functions.patterns import SPACE_IN_LINE
from corpusaudit.operators import catalogue as c
from corpusaudit.operators.catalogue import RULES

HIT_TYPE = "STRUCT<code: INT, line: INT, snippet: STRING, message: STRING, suggestion: STRING>"
NO_HITS = f"CAST(array() AS ARRAY<{HIT_TYPE}>)"

NODE_RULES = ("BUG004", "CPX001", "CPX002", "CPX004", "STY004", "STY005")
FILE_RULES = ("CPX003", "CPX005", "STY003")

_LENGTH = "(n.end_lineno - n.lineno + 1)"


def _hit(code, line, snippet, message=None, suggestion=None) -> str:
    null = "CAST(NULL AS STRING)"
    return (f"named_struct('code', {code}, 'line', {line}, 'snippet', {snippet}, 'message', {message or null}, "
            f"'suggestion', {suggestion or null})")


def _text(*parts) -> str:
    """Concatenation of literals and, in tuples of one, SQL expressions."""
    return "concat(" + ", ".join(p[0] if isinstance(p, tuple) else text.lit(p) for p in parts) + ")"


def _either(rule_id: str, high: str) -> str:
    return f"IF({high}, {RULES[rule_id].code(1)}, {RULES[rule_id].code(2)})"


_NAME = ("n.name",)
_IS_CLASS = "n.kind = 'class'"


def _node_rule(rule_id: str, lines: str) -> tuple[str, str]:
    """Condition on a node ``n`` and the hit it gives."""
    code = RULES[rule_id].code()
    if rule_id == "BUG004":
        return ("n.kind = 'import' AND n.last_of_name AND NOT n.used",
                _hit(code, "n.lineno", text.snippet(f"get({lines}, n.lineno - 1)"),
                     _text(RULES[rule_id].findings[0].message, _NAME)))
    if rule_id == "CPX001":
        return (f"n.kind = 'function' AND n.last_of_name AND n.complexity > {c.COMPLEXITY_THRESHOLD}",
                _hit(_either(rule_id, f"n.complexity > {c.HIGH_COMPLEXITY}"), "n.lineno",
                     _text("def ", _NAME, "(...):  # complexity=", ("n.complexity",)),
                     _text("Function '", _NAME, "' has cyclomatic complexity of ", ("n.complexity",),
                           f" (threshold: {c.COMPLEXITY_THRESHOLD})")))
    if rule_id == "CPX002":
        return (f"n.kind = 'function' AND {_LENGTH} > {c.FUNCTION_LINES_THRESHOLD}",
                _hit(_either(rule_id, f"{_LENGTH} > {c.LONG_FUNCTION_LINES}"), "n.lineno",
                     _text("def ", _NAME, "(...):  # ", (_LENGTH,), " lines"),
                     _text("Function '", _NAME, "' is ", (_LENGTH,),
                           f" lines long (threshold: {c.FUNCTION_LINES_THRESHOLD})")))
    if rule_id == "CPX004":
        return (f"n.kind = 'function' AND n.n_args > {c.ARGUMENTS_THRESHOLD}",
                _hit(code, "n.lineno", _text("def ", _NAME, "(...", ("n.n_args",), " args...):"),
                     _text("Function '", _NAME, "' has ", ("n.n_args",), f" parameters (threshold: {c.ARGUMENTS_THRESHOLD})")))
    if rule_id == "STY004":
        return ("n.kind IN ('function', 'class') AND NOT n.has_docstring AND n.name NOT RLIKE '^_(?!_)'",
                _hit(code, "n.lineno", _text((f"IF({_IS_CLASS}, 'class ', 'def ')",), _NAME, "(...):"),
                     _text((f"IF({_IS_CLASS}, 'Class ', 'Function ')",), "'", _NAME, "' has no docstring")))
    return ("n.kind = 'function' AND n.name RLIKE '^[a-z]+[A-Z][a-zA-Z0-9]*$' AND NOT startswith(n.name, 'test')",
            _hit(code, "n.lineno", _text("def ", _NAME, "(...):"),
                 _text("Function name '", _NAME, "' should be snake_case"),
                 _text("Rename to '", (text.snake_case("n.name"),), "'")))


def _node_hits(rule_id: str, nodes: str, lines: str) -> str:
    condition, hit = _node_rule(rule_id, lines)
    return f"coalesce(transform(filter({nodes}, n -> {condition}), n -> {hit}), {NO_HITS})"


def deep_nesting(language: str, content: str, lines: str) -> str:
    """One hit at the first deepest line. Only texts that have a line indented deep enough are measured."""
    limit = 4 * (c.NESTING_THRESHOLD + 1)
    rest = text.strip_left("l")
    depth = f"CAST(floor((length(l) - length({rest})) / 4) AS INT)"
    measured = (f"transform({lines}, (l, i) -> CASE WHEN {rest} <> '' AND NOT startswith({rest}, '#') "
                f"THEN named_struct('depth', {depth}, 'before', -i) END)")
    hit = _hit(RULES["CPX003"].code(), "1 - d.before", text.snippet(f"get({lines}, -d.before)"),
               _text("Code nested ", ("d.depth",), f" levels deep (threshold: {c.NESTING_THRESHOLD})"))
    deepest = f"filter(array(array_max({measured})), d -> d.depth > {c.NESTING_THRESHOLD})"
    indented = text.lit(f"(?d)(?m)^[{SPACE_IN_LINE}]{{{limit}}}")
    return f"CASE WHEN {language} = 'python' AND {content} RLIKE {indented} THEN transform({deepest}, d -> {hit}) ELSE {NO_HITS} END"


def large_file(language: str, content: str, lines: str) -> str:
    n = f"size({lines})"
    hit = _hit(_either("CPX005", f"{n} > {c.LARGE_FILE_LINES}"), "1", _text("# ", (n,), " lines total"),
               _text("File has ", (n,), f" lines (threshold: {c.FILE_LINES_THRESHOLD})"))
    # that many lines have that many line ends at least, so shorter texts are not cut into lines
    return f"CASE WHEN octet_length({content}) >= {c.FILE_LINES_THRESHOLD} AND {n} > {c.FILE_LINES_THRESHOLD} THEN array({hit}) ELSE {NO_HITS} END"


def mixed_indentation(language: str, content: str, lines: str) -> str:
    """A hit at the first line that starts with a tab, when another starts with four blanks."""
    tab, blanks = "\\t", "    "

    def starts(prefix):
        return f"(startswith({content}, '{prefix}') OR contains({content}, '\\n{prefix}'))"

    before = f"substring({content}, 1, instr({content}, '\\n{tab}'))"
    first = f"IF(startswith({content}, '{tab}'), 1, size({text.split_lines(before)}))"
    hit = _hit(RULES["STY003"].code(), first, "'Mixed indentation detected'")
    return f"CASE WHEN {starts(tab)} AND {starts(blanks)} THEN array({hit}) ELSE {NO_HITS} END"


_FILE_FUNCTIONS = {"CPX003": deep_nesting, "CPX005": large_file, "STY003": mixed_indentation}


def file_hits(rule_ids, language: str, content: str, lines: str, nodes: str) -> str:
    """All hits of the given file and fact rules, as one array."""
    parts = [_FILE_FUNCTIONS[r](language, content, lines) for r in rule_ids if r in _FILE_FUNCTIONS]
    parts += [_node_hits(r, nodes, lines) for r in rule_ids if r in NODE_RULES]
    return f"concat({', '.join(parts)})" if parts else NO_HITS
