"""Rules that look at one line: each gives a finding code or null, as one CASE per rule."""

from __future__ import annotations

from corpusaudit.functions import text
from corpusaudit.functions.patterns import SPACE_IN_LINE, WHITESPACE_CHARS
from corpusaudit.operators.catalogue import LINE_LENGTH_THRESHOLD, RULES, Finding, Rule

WHOLE_LINE_RULES = ("STY001", "STY002")
# One blank before a line end, which is sought first; without it, and with another last character, no line has trailing white space.
_BLANK_BEFORE_END = text.lit(rf"\n(?<=[{SPACE_IN_LINE}]\n)")
# English letters by how often they occur, rarest first: a search compares whole literals only where their first character stands.
_RAREST = "zqjxkvbpgwyfmculdrhsnioate"
LINE_RULES = tuple(r for r, rule in RULES.items()
                   if r in WHOLE_LINE_RULES or any(finding.pattern for finding in rule.findings))


def _bits(rule_ids) -> dict[tuple[str, int], int]:
    keys = [(r, variant) for r in rule_ids if r in LINE_RULES and r != "STY001"
            for variant in range(1, len(RULES[r].findings) + 1)]
    return {key: 1 << i for i, key in enumerate(keys)}


def candidates(rule_ids, language: str, content: str, folded: str) -> str:
    """Bit mask of the findings that may occur somewhere in a file.

    One look at the whole text for the literals a pattern cannot do without spares its lines the
    test: most files hold few of them. The mask also says whether a rule applies to the language.
    """
    parts = []
    for (rule_id, variant), bit in _bits(rule_ids).items():
        rule = RULES[rule_id]
        if rule_id == "STY002":
            parts.append(f"IF({_ends_blank(content)} OR {content} RLIKE {_BLANK_BEFORE_END}, {bit}L, 0L)")
            continue
        tests = _literals(rule.findings[variant - 1], content, folded)
        if rule.languages:
            tests.insert(0, f"{language} IN {text.in_list(rule.languages)}")
        parts.append(f"IF({' AND '.join(tests)}, {bit}L, 0L)")
    return " | ".join(parts) if parts else "0L"


def code(rule: Rule, rule_ids, maybe: str, line: str, folded: str) -> str:
    """Code of the first finding of the rule that the line shows, else null."""
    bits = _own_bits(rule, rule_ids)
    if rule.rule_id in WHOLE_LINE_RULES:
        tests = [*(_has(maybe, bit) for bit in bits.values()), _whole_line_test(rule, line)]
        return f"CASE WHEN {' AND '.join(tests)} THEN {rule.code()} END"
    return f"CASE WHEN {_has(maybe, sum(bits.values()))} THEN {_first_finding(rule, bits, maybe, line, folded)} END"


def codes_of_file(rule: Rule, rule_ids, maybe: str, lines: str, folded: str) -> str:
    """Codes of the rule's findings on all lines of a file, as an array: no line is looked at for a rule out of the mask."""
    bits = _own_bits(rule, rule_ids)
    if rule.rule_id in WHOLE_LINE_RULES:
        found = f"transform(filter({lines}, l -> {_whole_line_test(rule, 'l')}), l -> {rule.code()})"
    else:
        found = f"filter(zip_with({lines}, {folded}, (l, folded) -> {_first_finding(rule, bits, maybe, 'l', 'folded')}), c -> c IS NOT NULL)"
    return f"IF({_has(maybe, sum(bits.values()))}, {found}, CAST(array() AS ARRAY<INT>))" if bits else found


def _whole_line_test(rule: Rule, line: str) -> str:
    if rule.rule_id == "STY001":
        return f"octet_length({line}) > {LINE_LENGTH_THRESHOLD} AND length({line}) > {LINE_LENGTH_THRESHOLD}"
    return f"{_ends_blank(line)} AND {text.strip_right(line)} <> ''"


def _ends_blank(x: str) -> str:
    return f"{x} <> '' AND contains({text.lit(WHITESPACE_CHARS)}, right({x}, 1))"


def _own_bits(rule: Rule, rule_ids) -> dict[int, int]:
    return {variant: bit for (rule_id, variant), bit in _bits(rule_ids).items() if rule_id == rule.rule_id}


def _first_finding(rule: Rule, bits: dict[int, int], maybe: str, line: str, folded: str) -> str:
    branches = " ".join(
        f"WHEN {' AND '.join([_has(maybe, bits[v]), *_literals(f, line, folded), text.matches(line, f.pattern)])} "
        f"THEN {rule.code(v)}" for v, f in enumerate(rule.findings, 1))
    return f"CASE {branches} END"


def _has(maybe: str, bits: int) -> str:
    return f"({maybe} & {bits}L) <> 0L"


def _literals(finding: Finding, x: str, folded: str) -> list[str]:
    """Cheap tests that hold whenever the finding's pattern matches in the text."""
    def found(literal, where):
        rare = _rare_end(literal)
        return " AND ".join(f"contains({where}, {text.lit(o)})" for o in dict.fromkeys((rare, literal)))

    def either(options, where):
        return "(" + " OR ".join(f"({found(o, where)})" for o in options) + ")"

    tests = [either("\"'" if c == "q" else c, x) for c in finding.needs]
    return [*tests, either(finding.hints, folded)] if finding.hints else tests


def _rare_end(literal: str) -> str:
    """The end of a literal, of two characters at least, that begins with its rarest one; marks and digits count as rare."""
    starts = range(max(len(literal) - 1, 1))
    return literal[min(starts, key=lambda i: _RAREST.find(literal[i])):]


def message(code_column: str, line: str) -> str:
    """Message of a line hit where it depends on the line; null where the catalogue's is used."""
    todo, long_line = RULES["BUG006"], RULES["STY001"]
    return (f"CASE {code_column} "
            f"WHEN {todo.code()} THEN concat({text.lit(todo.findings[0].message)}, substring({text.strip(line)}, 1, 80)) "
            f"WHEN {long_line.code()} THEN concat('Line is ', length({line}), ' characters (threshold: {LINE_LENGTH_THRESHOLD})') END")


def snippet(code_column: str, line: str) -> str:
    return (f"CASE {code_column} WHEN {RULES['STY001'].code()} THEN concat(substring({line}, 1, 120), '...') "
            f"WHEN {RULES['STY002'].code()} THEN substring({text.strip_right(line)}, 1, 120) ELSE {text.snippet(line)} END")
