"""Line classes and definition counts of one file, as SQL expressions on its row (no shuffle)."""

from __future__ import annotations

from corpusaudit import dims
from corpusaudit.functions import text
from corpusaudit.functions.patterns import compile_pattern

# --- fixed values: definition patterns per language -------------------------------------------
FUNCTION_PATTERNS = {
    "javascript": r"\bfunction\s+\w+|=>\s*[{(]",
    "typescript": r"\bfunction\s+\w+|=>\s*[{(]",
    "go": r"func\s+\w+",
    "rust": r"fn\s+\w+",
    "ruby": r"def\s+\w+",
    "php": r"function\s+\w+",
    "swift": r"func\s+\w+",
    "kotlin": r"fun\s+\w+",
    "scala": r"def\s+\w+",
    # one line's blanks are enough before the name: what comes before them on other lines changes no match
    "shell": r"^[^\S\n]*\w+\s*\(\s*\)\s*\{",
    "lua": r"function\s+\w+",
    "perl": r"sub\s+\w+",
    "dart": r"(?:void|int|String|bool|double|dynamic|Future|Stream)\s+\w+\s*\(",
}

# C-like headers end with a closing parenthesis: "closed", or one with "{" behind it: "opened". What stands between two closing
# parentheses is the place of one header at most, so each such piece is looked at once, for the pattern up to the opening one.
# A header begins where a run of its first characters begins (for java and csharp behind white space, or where the run holds a
# modifier and more), so that no run is read twice.
_TYPED = (r"(?:(?<=\s)|(?<![\w<>\[\]])(?=[\w<>\[\]]*?(?:public|private|protected|static)[\w<>\[\]]))"
          r"[\w<>\[\]]+\s+\w+\s*\(")
HEADER_PATTERNS = {
    "java": {"opened": _TYPED},
    "c": {"opened": r"(?<![\w\*])[\w\*]+\s+\w+\s*\("},
    "cpp": {"closed": r"(?<![\w\*:])[\w\*:]+::\w+\s*\(", "opened": r"(?<![\w\*])[\w\*]+\s+\w+\s*\("},
    "csharp": {"closed": _TYPED},
}

CLASS_PATTERNS = {
    "javascript": r"\bclass\s+\w+",
    "typescript": r"\bclass\s+\w+",
    "java": r"\b(?:class|interface|enum)\s+\w+",
    "cpp": r"\b(?:class|struct)\s+\w+",
    "csharp": r"\b(?:class|interface|struct|enum)\s+\w+",
    "php": r"\b(?:class|interface|trait)\s+\w+",
    "swift": r"\b(?:class|struct|protocol|enum)\s+\w+",
    "kotlin": r"\b(?:class|interface|object|enum)\s+\w+",
    "scala": r"\b(?:class|object|trait)\s+\w+",
    "ruby": r"\b(?:class|module)\s+\w+",
    "dart": r"\b(?:class|mixin|enum)\s+\w+",
}

# --- end of fixed values ----------------------------------------------------------------------


def body(content: str) -> str:
    """The text that statistics look at: without trailing newlines."""
    return f"trim(TRAILING '\\n' FROM {content})"


def line_classes(language: str, content: str) -> str:
    """Struct (blank, comment, code) of line counts. How a line begins decides, so lines are stripped on the left only.

    Comments that span lines need a fold, which is left to texts that hold what opens one: four times the comment lines so
    far, plus the kind of comment that is open.
    """
    stripped = f"transform({text.split_lines(body(content))}, x -> {text.strip_left('x')})"
    single, double = text.lit("'''"), text.lit('"""')

    def starts(prefix):
        return f"size(filter(s, l -> startswith(l, {prefix})))"

    def fold(*branches):
        return f"CAST(shiftright(aggregate(s, 0L, (a, l) -> CASE WHEN l = '' THEN a {' '.join(branches)} ELSE a END), 2) AS INT)"

    def inside(kind, closing):
        return f"WHEN (a & 3L) = {kind}L THEN IF(contains(l, {closing}), a + {4 - kind}L, a + 4L)"

    def opening(kind, mark, closing, rest):
        return f"WHEN startswith(l, {mark}) THEN IF(contains(substring(l, {rest}), {closing}), a + 4L, a + {4 + kind}L)"

    python = fold("WHEN startswith(l, '#') THEN a + 4L", inside(1, double), inside(2, single),
                  opening(1, double, double, 4), opening(2, single, single, 4))
    block = fold(inside(1, "'*/'"), opening(1, "'/*'", "'*/'", 3), "WHEN startswith(l, '//') THEN a + 4L")
    comment = (f"CASE WHEN {language} = 'python' THEN IF(contains({content}, {double}) OR contains({content}, {single}), {python}, {starts(text.lit('#'))}) "
               f"WHEN {language} IN {text.in_list(dims.BLOCK_COMMENT_LANGUAGES)} THEN IF(contains({content}, '/*'), {block}, {starts(text.lit('//'))}) "
               f"ELSE {starts(text.case_of(language, dims.LINE_COMMENT_LANGUAGES))} END")
    counted = (f"transform(array({stripped}), s -> CASE WHEN s IS NOT NULL THEN named_struct('lines', size(s), "
               f"'blank', size(filter(s, l -> l = '')), 'comment', {comment}) END)")
    return (f"get(transform({counted}, k -> named_struct('blank', k.blank, 'comment', k.comment, "
            f"'code', k.lines - k.blank - k.comment)), 0)")


def _count(patterns: dict[str, str], content: str) -> dict[str, str]:
    return {name: f"regexp_count({body(content)}, {text.lit(compile_pattern(pattern, multiline=True))})"
            for name, pattern in patterns.items()}


def _count_headers(patterns: dict[str, str], content: str) -> str:
    """A fold over the pieces between closing parentheses: what the last piece left open, and the headers so far."""
    finds = {kind: f"s RLIKE {text.lit(compile_pattern(pattern))}" for kind, pattern in patterns.items()}
    left = f"CASE WHEN NOT contains(s, '(') THEN 0 WHEN {finds.get('closed', 'false')} THEN 2 WHEN {finds.get('opened', 'false')} THEN 1 ELSE 0 END"
    brace = text.lit(compile_pattern(r"^\s*\{"))
    counted = f"a.n + CAST(a.left = 2 OR (a.left = 1 AND s RLIKE {brace}) AS INT)"
    return f"aggregate(split({body(content)}, '[)]', -1), named_struct('n', 0, 'left', 0), (a, s) -> named_struct('n', {counted}, 'left', {left})).n"


def _of_language(counts: dict[str, str], language: str) -> str:
    return f"CASE {language} {' '.join(f'WHEN {text.lit(name)} THEN {count}' for name, count in counts.items())} ELSE 0 END"


def count_functions(language: str, content: str) -> str:
    """Function headers of a non-Python file, by its language's pattern; 0 without one."""
    counts = _count(FUNCTION_PATTERNS, content)
    counts |= {name: _count_headers(patterns, content) for name, patterns in HEADER_PATTERNS.items()}
    return _of_language(counts, language)


def count_classes(language: str, content: str) -> str:
    return _of_language(_count(CLASS_PATTERNS, content), language)
