"""DuckDB SQL for the registered queries, written apart from the library.

Patterns are in RE2 syntax with Unicode classes spelled out; structure facts come from the chunk truth
table instead of a parser; the line-class state machines are string folds.
"""

from __future__ import annotations

from corpusaudit.operators.catalogue import RULES
from workload.code_corpus import PYTHON, chunk_lines_sql, chunk_truth_sql, code_sql, sql_text
from workload.queries import DETAIL_PATH, EXCLUDED, ROOT

S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\p{L}\p{N}_]"
END = r"(?:[^\p{L}\p{N}_]|$)"
WS = "'" + "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200b))) + \
     "    　" + "'"

# --- corpus -----------------------------------------------------------------------------------

LANGUAGES = {
    "python": [".py"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"],
    "csharp": [".cs"],
    "go": [".go"],
    "rust": [".rs"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt"],
    "scala": [".scala"],
    "shell": [".sh", ".bash"],
    "sql": [".sql"],
    "html": [".html", ".htm"],
    "css": [".css"],
    "sass": [".scss"],
    "less": [".less"],
    "json": [".json"],
    "yaml": [".yaml", ".yml"],
    "xml": [".xml"],
    "markdown": [".md"],
    "toml": [".toml"],
    "ini": [".ini", ".cfg"],
    "r": [".r"],
    "lua": [".lua"],
    "perl": [".pl"],
    "dart": [".dart"],
}
NOT_SCANNED = [".mjs", ".cxx"]
LANGUAGE_CASE = "CASE " + " ".join(
    f"WHEN ext IN ({', '.join(sql_text(e) for e in exts)}) THEN '{name}'" for name, exts in LANGUAGES.items()
) + " ELSE 'unknown' END"
SCANNED = ", ".join(sql_text(e) for exts in LANGUAGES.values() for e in exts if e not in NOT_SCANNED)

RAW = f"""
code AS ({code_sql()}),
raw AS (
  SELECT path, content, lower(regexp_extract(path, '[^./][^/]*(\\.[^./]*)$', 1)) AS ext FROM (
    SELECT path, content FROM code
    UNION ALL SELECT source || '/' || doc_id || '.md', text FROM documents
    UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages
    UNION ALL SELECT 'conversations/' || conv_id || '/' || turn || '.md', text FROM conversations)),
files AS (
  SELECT path, content, {LANGUAGE_CASE} AS language FROM raw
  WHERE ext IN ({SCANNED}) AND NOT list_has_any(string_split(path, '/')[:-2], ['node_modules', '.hidden'])
    AND strlen(content) <= 1048576),
lines AS (
  SELECT path, language, unnest(parts) AS line, unnest(range(1, len(parts) + 1))::INTEGER AS line_no
  FROM (SELECT path, language, string_split(content, chr(10)) AS parts FROM files))"""

NODES = f"""
truth AS ({chunk_truth_sql()}),
chunk_size AS ({chunk_lines_sql()}),
placed AS (
  SELECT path, i, (k * 7 + i * 11) % {len(PYTHON)} AS chunk
  FROM (SELECT code.k, code.path FROM code JOIN files USING (path) WHERE family = 'p' AND k % 29 <> 0),
       unnest(range(0, 3 + k % 9)) AS t(i)),
started AS (
  SELECT path, i, chunk, 3 + coalesce(sum(n_lines) OVER (
    PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS first
  FROM placed JOIN chunk_size USING (chunk)),
nodes AS (
  SELECT *, row_number() OVER (PARTITION BY path, kind, name ORDER BY
      CASE WHEN kind = 'import' THEN walk_seq ELSE visit_seq END DESC) = 1 AS last_of_name
  FROM (SELECT path, kind, name, (first + line)::INTEGER AS lineno, (first + last)::INTEGER AS end_lineno,
          n_args::INTEGER AS n_args, doc AS has_docstring, complexity::INTEGER AS complexity,
          row_number() OVER (PARTITION BY path ORDER BY depth, i, idx)::INTEGER AS walk_seq,
          CASE WHEN kind = 'function' THEN row_number() OVER (
            PARTITION BY path, kind ORDER BY i, visit) ELSE 0 END::INTEGER AS visit_seq
        FROM started JOIN truth USING (chunk))),
imports AS (SELECT path, name, lineno FROM nodes WHERE kind = 'import' AND last_of_name),
uses AS (
  SELECT DISTINCT i.path, i.name FROM imports i JOIN lines l ON l.path = i.path AND l.line_no <> i.lineno
  WHERE NOT starts_with(trim(l.line, {WS}), 'import') AND NOT starts_with(trim(l.line, {WS}), 'from')
    AND CASE WHEN i.name = '*' THEN regexp_matches(l.line, '{W}\\*{W}')
        ELSE list_contains(regexp_extract_all(l.line, '{W}+'), i.name) END)"""

# --- line rules -------------------------------------------------------------------------------

Q, NQ = "[\"'']", "[^\"'']"

LINE_PATTERNS = {
    "SEC001": [
        f"(?i)(?:password|passwd|pwd){S}*[:=]{S}*{Q}{NQ}{{4,}}{Q}",
        f"(?i)(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token){S}*[:=]{S}*{Q}[A-Za-z0-9_-]{{8,}}{Q}",
        f"(?i)(?:private[_-]?key|secret){S}*[:=]{S}*{Q}-----BEGIN",
        "AKIA[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36}", "sk_[A-Za-z0-9]{20,}",
        f"(?i)(?:db[_-]?url|database[_-]?url|connection[_-]?string){S}*[:=]{S}*{Q}{NQ}*:{NQ}*@",
        f"(?i)(?:jwt|json[_-]web[_-]?token){S}*[:=]{S}*{Q}eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+{Q}",
    ],
    "SEC002": [
        f"(?i)(?:execute|db\\.query){S}*\\({S}*{Q}{NQ}*{Q}{S}*\\+",
        f"(?i)execute{S}*\\({S}*f{Q}",
        f"(?i)execute{S}*\\({S}*{Q}{NQ}*%{S}*\\(.*\\)",
        f"(?i)SELECT.*FROM.*\\+{S}*{W}",
    ],
    "SEC003": [
        f"(?i)(?:os\\.system|subprocess\\.(?:call|run|Popen)){S}*\\({S}*{Q}?{NQ}*{Q}?{S}*\\+",
        f"(?i)(?:os\\.system|subprocess\\.(?:call|run)){S}*\\({S}*f{Q}",
        f"(?i)shell{S}*={S}*True", f"(?i)eval{S}*\\(", f"(?i)exec{S}*\\(",
    ],
    "SEC004": [
        f"(?i)pickle\\.loads?{S}*\\(", None, f"(?i)marshal\\.loads?{S}*\\(", f"(?i)shelve\\.open{S}*\\(",
    ],
    "SEC005": [
        f"(?i)md5{S}*\\(", f"(?i)sha1{S}*\\(", f"(?i)DES{END}", f"(?i)RC4{END}",
        f"(?i)random\\.random{S}*\\(\\)", f"(?i)random\\.randint{S}*\\(",
    ],
    "SEC006": [
        f"{Q}https?://(?:\\p{{Nd}}{{1,3}}\\.){{3}}\\p{{Nd}}{{1,3}}{NQ}*{Q}|{Q}(?:\\p{{Nd}}{{1,3}}\\.){{3}}\\p{{Nd}}{{1,3}}{Q}",
    ],
    "BUG001": [f"^{S}*except{S}*:"],
    "BUG002": [f"def{S}+{W}+{S}*\\([^)]*={S}*(?:\\[\\]|\\{{\\}}|set\\(\\)|dict\\(\\)|list\\(\\))"],
    "BUG003": [f"[=!]={S}*None"],
    "BUG005": [f"^{S}*print{S}*\\("],
    "BUG006": [f"(?i)(?:TODO|FIXME|HACK|XXX|BUG)(?:{S}|:)"],
    "BUG007": [f"^{S}*except{S}+Exception{S}*:"],
}
# yaml.load: no "loader" after the closing parenthesis of the last call in the line
YAML = (f"(regexp_matches(line, '(?i)yaml\\.load{S}*\\([^)]*\\)') AND NOT contains(lower(regexp_extract(line, "
        f"'(?i).*yaml\\.load{S}*\\([^)]*\\)(.*)$', 1)), 'loader'))")
PYTHON_RULES = ["BUG001", "BUG002", "BUG003", "BUG005", "BUG007"]

# rule: (category, confidence, severity per variant)
EMITTED = {
    "SEC001": ("security", 0.9, ["critical"] * 6 + ["high"] * 2), "SEC002": ("security", 0.7, ["high"] * 4),
    "SEC003": ("security", 0.8, ["high"] * 3 + ["critical"] * 2), "SEC004": ("security", 0.85, ["high"] * 4),
    "SEC005": ("security", 0.75, ["high", "medium", "high", "medium", "medium", "medium"]),
    "SEC006": ("security", 0.6, ["low"]), "BUG001": ("bug", 0.95, ["medium"]), "BUG002": ("bug", 0.9, ["high"]),
    "BUG003": ("bug", 0.85, ["low"]), "BUG004": ("maintainability", 0.6, ["info"]),
    "BUG005": ("maintainability", 0.5, ["info"]), "BUG006": ("maintainability", 1.0, ["info"]),
    "BUG007": ("bug", 0.7, ["low"]), "CPX001": ("complexity", 0.95, ["high", "medium"]),
    "CPX002": ("complexity", 0.9, ["medium", "low"]), "CPX003": ("complexity", 0.8, ["medium"]),
    "CPX004": ("complexity", 0.85, ["low"]), "CPX005": ("complexity", 0.9, ["medium", "low"]),
    "STY001": ("style", 1.0, ["info"]), "STY002": ("style", 1.0, ["info"]), "STY003": ("style", 0.9, ["low"]),
    "STY004": ("style", 0.7, ["info"]), "STY005": ("style", 0.6, ["info"]),
}
ORDER = list(EMITTED)
SNIP = f"trim(line, {WS})[:120]"


def _hit(rule_id, source, line, variant="1", message="NULL", snippet="NULL", suggestion="NULL", where="true"):
    return (f"SELECT path, {line} AS line, '{rule_id}' AS rule_id, ({variant})::INTEGER AS variant, {message} AS own_message, "
            f"{snippet} AS snippet, {suggestion} AS own_suggestion FROM {source} WHERE {where}")


def _line_rule(rule_id):
    tests = []
    for n, pattern in enumerate(LINE_PATTERNS[rule_id], 1):
        test = YAML if pattern is None else f"regexp_matches(line, '{pattern}')"
        tests.append(f"WHEN {test} THEN {n}")
    message = f"'Unresolved marker in comment: ' || trim(line, {WS})[:80]" if rule_id == "BUG006" else "NULL"
    gate = "WHERE language = 'python'" if rule_id in PYTHON_RULES else ""
    source = f"(SELECT path, line, line_no, CASE {' '.join(tests)} END AS variant FROM lines {gate})"
    return _hit(rule_id, source, "line_no", "variant", message, SNIP, where="variant IS NOT NULL")


FUNCTION = "kind = 'function'"
LENGTH = "(end_lineno - lineno + 1)"
DEPTH = f"((length(line) - length(ltrim(line, {WS}))) // 4)"

RULE_SQL = {rule_id: _line_rule(rule_id) for rule_id in LINE_PATTERNS}
RULE_SQL |= {
    "BUG004": _hit("BUG004", "imports JOIN lines USING (path)", "lineno", message="'Potentially unused import: ' || name",
                   snippet=SNIP, where="line_no = lineno AND (path, name) NOT IN (SELECT (path, name) FROM uses)"),
    "CPX001": _hit("CPX001", "nodes", "lineno", "CASE WHEN complexity > 20 THEN 1 ELSE 2 END",
                   "'Function ''' || name || ''' has cyclomatic complexity of ' || complexity || ' (threshold: 10)'",
                   "'def ' || name || '(...):  # complexity=' || complexity",
                   where=f"{FUNCTION} AND last_of_name AND complexity > 10"),
    "CPX002": _hit("CPX002", "nodes", "lineno", f"CASE WHEN {LENGTH} > 100 THEN 1 ELSE 2 END",
                   f"'Function ''' || name || ''' is ' || {LENGTH} || ' lines long (threshold: 50)'",
                   f"'def ' || name || '(...):  # ' || {LENGTH} || ' lines'", where=f"{FUNCTION} AND {LENGTH} > 50"),
    "CPX003": _hit("CPX003", f"(SELECT path, line, line_no, {DEPTH} AS depth, row_number() OVER (PARTITION BY path "
                   f"ORDER BY {DEPTH} DESC, line_no) AS rn FROM lines WHERE language = 'python' AND trim(line, {WS}) <> '' "
                   f"AND NOT starts_with(trim(line, {WS}), '#'))", "line_no",
                   message="'Code nested ' || depth || ' levels deep (threshold: 4)'", snippet=SNIP,
                   where="rn = 1 AND depth > 4"),
    "CPX004": _hit("CPX004", "nodes", "lineno", message="'Function ''' || name || ''' has ' || n_args || ' parameters (threshold: 5)'",
                   snippet="'def ' || name || '(...' || n_args || ' args...):'", where=f"{FUNCTION} AND n_args > 5"),
    "CPX005": _hit("CPX005", "(SELECT path, count(*) AS n FROM lines GROUP BY path)", "1::INTEGER",
                   "CASE WHEN n > 1000 THEN 1 ELSE 2 END", "'File has ' || n || ' lines (threshold: 500)'",
                   "'# ' || n || ' lines total'", where="n > 500"),
    "STY001": _hit("STY001", "lines", "line_no", message="'Line is ' || length(line) || ' characters (threshold: 120)'",
                   snippet="line[:120] || '...'", where="length(line) > 120"),
    "STY002": _hit("STY002", "lines", "line_no", snippet=f"rtrim(line, {WS})[:120]",
                   where=f"line <> rtrim(line, {WS}) AND trim(line, {WS}) <> ''"),
    "STY003": _hit("STY003", "(SELECT path, min(CASE WHEN starts_with(line, chr(9)) THEN line_no END) AS tab, "
                   "bool_or(starts_with(line, '    ')) AS blanks FROM lines GROUP BY path)", "tab",
                   snippet="'Mixed indentation detected'", where="tab IS NOT NULL AND blanks"),
    "STY004": _hit("STY004", "nodes", "lineno",
                   message="CASE kind WHEN 'class' THEN 'Class ''' ELSE 'Function ''' END || name || ''' has no docstring'",
                   snippet="CASE kind WHEN 'class' THEN 'class ' ELSE 'def ' END || name || '(...):'",
                   where="kind <> 'import' AND NOT has_docstring AND (name[1] <> '_' OR name[:2] = '__')"),
    "STY005": _hit("STY005", "nodes", "lineno", message="'Function name ''' || name || ''' should be snake_case'",
                   snippet="'def ' || name || '(...):'",
                   suggestion="'Rename to ''' || lower(regexp_replace(name, '([A-Z])', '_\\1', 'g')) || ''''",
                   where=f"{FUNCTION} AND regexp_matches(name, '^[a-z]+[A-Z][a-zA-Z0-9]*$') AND NOT starts_with(name, 'test')"),
}
NODE_RULES = ["BUG004", "CPX001", "CPX002", "CPX004", "STY004", "STY005"]


def _emitted_values():
    rows = []
    for order, (rule_id, (category, confidence, severities)) in enumerate(EMITTED.items(), 1):
        rule = RULES[rule_id]
        for variant, severity in enumerate(severities, 1):
            rows.append(f"('{rule_id}', {variant}, {order}, {sql_text(rule.rule_name)}, '{category}', '{severity}', "
                        f"{sql_text(rule.findings[variant - 1].message)}, {sql_text(rule.suggestion)}, {confidence}::DOUBLE)")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + \
        ") t(rule_id, variant, rule_ord, rule_name, category, severity, message, suggestion, confidence)"


WEIGHT = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 WHEN 'low' THEN 5 ELSE 1 END"
SEVERITY_ORDER = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def _issues(rule_ids):
    return f"""
emitted AS ({_emitted_values()}),
hits AS ({' UNION ALL '.join(RULE_SQL[r] for r in rule_ids)}),
issues AS (
  SELECT h.rule_id, rule_ord, rule_name, category, severity, coalesce(own_message, message) AS message, path, line,
    snippet, coalesce(own_suggestion, suggestion) AS suggestion, confidence, {WEIGHT} * confidence AS score
  FROM hits h JOIN emitted e ON e.rule_id = h.rule_id AND e.variant = h.variant)"""


ISSUES = _issues(list(EMITTED))

# --- file statistics --------------------------------------------------------------------------

C_LIKE = "('c', 'cpp', 'java', 'javascript', 'typescript', 'csharp', 'go', 'rust', 'php', 'swift', 'kotlin', 'scala')"
PREFIX = ("CASE WHEN language IN ('python', 'shell', 'ruby', 'perl', 'r') THEN '#' WHEN language IN ('sql', 'lua') THEN '--' "
          f"WHEN language IN {C_LIKE} THEN '//' END")
TD, TS = "'\"\"\"'", "''''''''"
# The folded string is a state (0, or what is open) followed by one letter per line: b, c or k.
PYTHON_FOLD = f"""list_reduce(parts, lambda a, l:
  CASE WHEN l = '' THEN a || 'b' WHEN l[1] = '#' THEN a || 'c'
    WHEN a[1] = 'd' THEN CASE WHEN contains(l, {TD}) THEN '0' ELSE 'd' END || a[2:] || 'c'
    WHEN a[1] = 's' THEN CASE WHEN contains(l, {TS}) THEN '0' ELSE 's' END || a[2:] || 'c'
    WHEN l[:3] = {TD} THEN CASE WHEN contains(l[4:], {TD}) THEN '0' ELSE 'd' END || a[2:] || 'c'
    WHEN l[:3] = {TS} THEN CASE WHEN contains(l[4:], {TS}) THEN '0' ELSE 's' END || a[2:] || 'c'
    ELSE a || 'k' END, '0')"""
BLOCK_FOLD = """list_reduce(parts, lambda a, l:
  CASE WHEN l = '' THEN a || 'b'
    WHEN a[1] = '*' THEN CASE WHEN contains(l, '*/') THEN '0' ELSE '*' END || a[2:] || 'c'
    WHEN l[:2] = '/*' THEN CASE WHEN contains(l[3:], '*/') THEN '0' ELSE '*' END || a[2:] || 'c'
    WHEN l[:2] = '//' THEN a || 'c' ELSE a || 'k' END, '0')"""
PLAIN_FOLD = """'0' || array_to_string(list_transform(parts, lambda l:
  CASE WHEN l = '' THEN 'b' WHEN prefix IS NOT NULL AND starts_with(l, prefix) THEN 'c' ELSE 'k' END), '')"""

FUNCTIONS = {
    "javascript": rf"\bfunction\s+{W}+|=>\s*[{{(]", "typescript": rf"\bfunction\s+{W}+|=>\s*[{{(]",
    "java": r"(?:public|private|protected|static|\s)+[\p{L}\p{N}_<>\[\]]+\s+" + W + r"+\s*\([^)]*\)\s*\{",
    "c": r"[\p{L}\p{N}_*]+\s+" + W + r"+\s*\([^)]*\)\s*\{",
    "cpp": r"[\p{L}\p{N}_*:]+::" + W + r"+\s*\([^)]*\)|[\p{L}\p{N}_*]+\s+" + W + r"+\s*\([^)]*\)\s*\{",
    "csharp": r"(?:public|private|protected|static|\s)+[\p{L}\p{N}_<>\[\]]+\s+" + W + r"+\s*\([^)]*\)",
    "go": rf"func\s+{W}+", "rust": rf"fn\s+{W}+", "ruby": rf"def\s+{W}+", "php": rf"function\s+{W}+",
    "swift": rf"func\s+{W}+", "kotlin": rf"fun\s+{W}+", "scala": rf"def\s+{W}+",
    "shell": rf"(?m)^\s*{W}+\s*\(\s*\)\s*\{{", "lua": rf"function\s+{W}+", "perl": rf"sub\s+{W}+",
    "dart": rf"(?:void|int|String|bool|double|dynamic|Future|Stream)\s+{W}+\s*\(",
}
CLASSES = {
    "javascript": "class", "typescript": "class", "java": "class|interface|enum", "cpp": "class|struct",
    "csharp": "class|interface|struct|enum", "php": "class|interface|trait", "swift": "class|struct|protocol|enum",
    "kotlin": "class|interface|object|enum", "scala": "class|object|trait", "ruby": "class|module",
    "dart": "class|mixin|enum",
}


def _count(patterns):
    return "CASE language " + " ".join(
        f"WHEN '{name}' THEN len(regexp_extract_all(rtrim(content, chr(10)), '{p}'))" for name, p in patterns.items()
    ) + " ELSE 0 END::INTEGER"


FUNCTION_COUNT = _count(FUNCTIONS)
CLASS_COUNT = _count({name: rf"\b(?:{words})\s+{W}+" for name, words in CLASSES.items()})

STATS = f"""
folded AS (
  SELECT path, language, len(parts)::INTEGER AS lines, CASE WHEN language = 'python' THEN {PYTHON_FOLD}
    WHEN language IN {C_LIKE} THEN {BLOCK_FOLD} ELSE {PLAIN_FOLD} END AS kinds
  FROM (SELECT path, language, {PREFIX} AS prefix, list_transform(string_split(rtrim(content, chr(10)), chr(10)),
          lambda l: trim(l, {WS})) AS parts FROM files)),
line_classes AS (
  SELECT path, language, lines, length(replace(replace(kinds[2:], 'c', ''), 'k', ''))::INTEGER AS blank_lines,
    length(replace(replace(kinds[2:], 'b', ''), 'k', ''))::INTEGER AS comment_lines,
    length(replace(replace(kinds[2:], 'b', ''), 'c', ''))::INTEGER AS code_lines FROM folded),
py_stats AS (
  SELECT path, count(*) FILTER (kind = 'function')::INTEGER AS functions, count(*) FILTER (kind = 'class')::INTEGER AS classes,
    coalesce(max(complexity) FILTER (kind = 'function' AND last_of_name), 0)::INTEGER AS max_complexity,
    coalesce(avg(complexity) FILTER (kind = 'function' AND last_of_name), 0.0)::DOUBLE AS avg_complexity
  FROM nodes GROUP BY path),
stats AS (
  SELECT path, f.language, lines, blank_lines, comment_lines, code_lines,
    CASE WHEN f.language = 'python' THEN coalesce(p.functions, 0) ELSE {FUNCTION_COUNT} END AS functions,
    CASE WHEN f.language = 'python' THEN coalesce(p.classes, 0) ELSE {CLASS_COUNT} END AS classes,
    coalesce(p.max_complexity, 0) AS max_complexity, coalesce(p.avg_complexity, 0.0) AS avg_complexity
  FROM files f JOIN (SELECT * EXCLUDE (language) FROM line_classes) c USING (path) LEFT JOIN py_stats p USING (path))"""

PROFILE = """
profile AS (
  SELECT s.*, coalesce(n, 0) AS issue_count, coalesce(risk, 0.0) AS score FROM stats s LEFT JOIN (
    SELECT path, count(*) AS n, round(sum(score), 6) AS risk FROM issues GROUP BY path) USING (path))"""

# --- duplicates -------------------------------------------------------------------------------

NUMBER = r"(^|[^\p{L}\p{N}_])\p{Nd}+([^\p{L}\p{N}_]|$)"


def _normal(x):
    for pattern, new in [("#.*$", ""), ("//.*$", ""), (f"{S}+", " "), ('"[^"]*"', '"STR"'), ("''[^'']*''", "''STR''"),
                         (NUMBER, r"\1NUM\2"), (NUMBER, r"\1NUM\2")]:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"trim({x}, {WS})"


def _windows(files="files"):
    return f"""
normal AS (SELECT path, list_transform(string_split(content, chr(10)), lambda l: {_normal(f"trim(l, {WS})")}) AS parts FROM {files}),
windows AS (
  SELECT path, start_line, parts[start_line:start_line + 4] AS block
  FROM (SELECT path, parts, unnest(range(1, len(parts) - 3))::INTEGER AS start_line FROM normal)),
telling AS (
  SELECT path, start_line, block FROM windows
  WHERE len(list_filter(block, lambda l: l NOT IN ('', '{{', '}}', 'else:', 'pass'))) >= 2),
hashed AS (SELECT path, start_line, block, md5(array_to_string(block, chr(10))) AS hash FROM telling),
groups AS (
  SELECT hash, 5 AS line_count, count(*) AS n_occ, min((path, start_line)) AS first FROM hashed GROUP BY hash
  HAVING count(*) >= 2),
groups_flat AS (SELECT hash, line_count, n_occ, first[1] AS first_path, first[2] AS first_line FROM groups)"""


WINDOWS = _windows()
TOP20 = "SELECT * FROM groups_flat ORDER BY n_occ DESC, first_path, first_line, hash LIMIT 20"

# --- debt -------------------------------------------------------------------------------------


def _round(x, digits):
    return f"format('{{:.{digits}f}}', ({x})::DOUBLE)::DOUBLE"


SEVERITIES = ["critical", "high", "medium", "low", "info"]
CATEGORIES = ["security", "bug", "complexity", "style", "duplicate", "maintainability"]
MINUTES = {"critical": 120, "high": 60, "medium": 20, "low": 5, "info": 1}


def _measures(total="true"):
    by_severity = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in SEVERITIES)
    by_category = ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in CATEGORIES)
    debts = ", ".join(f"n_{s} * {m} AS debt_{s}" for s, m in MINUTES.items())
    return f"""
totals AS (
  SELECT *, {debts}, complexity_minutes AS debt_complexity, duplicate_blocks * 30 AS debt_duplicates,
    total_issues / total_code_lines * 1000 AS kloc, 100 - least(total_issues / total_code_lines * 1000 * 2 +
      (n_critical * 100 + n_high * 50 + n_medium * 20 + n_low * 5 + n_info) * 0.01, 90) AS score
  FROM (SELECT {by_severity}, {by_category}, count(*) FILTER ({total}) AS total_issues,
          count(DISTINCT path) AS files_with_issues FROM issues),
       (SELECT count(*) AS files_scanned, sum(code_lines)::BIGINT AS total_code_lines,
          sum(CASE WHEN max_complexity > 10 THEN (max_complexity - 10) * 10 ELSE 0 END)::BIGINT AS complexity_minutes FROM stats),
       (SELECT count(*) AS duplicate_blocks FROM groups)),
minutes AS (
  SELECT *, debt_critical + debt_high + debt_medium + debt_low + debt_info + debt_complexity + debt_duplicates AS total_debt_minutes
  FROM totals),
measures AS (
  SELECT * EXCLUDE (score), score, {_round('total_debt_minutes / 60', 1)} AS total_debt_hours,
    {_round('total_debt_minutes / 480', 1)} AS total_debt_days,
    CASE WHEN total_debt_minutes >= 480 THEN (total_debt_minutes // 480) || 'd ' || (total_debt_minutes // 60 % 8) || 'h '
      || (total_debt_minutes % 60) || 'm' ELSE (total_debt_minutes // 60) || 'h ' || (total_debt_minutes % 60) || 'm' END AS formatted,
    {_round('score', 1)} AS quality_score, {_round('kloc', 2)} AS issues_per_kloc,
    CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
    CASE WHEN n_critical > 0 OR score < 40 THEN 'critical' WHEN n_high > 3 OR score < 60 THEN 'high'
      WHEN score < 80 THEN 'medium' ELSE 'low' END AS risk_level
  FROM minutes)"""


# --- assembly ---------------------------------------------------------------------------------

def q(select, *parts):
    return "WITH " + ",".join(p.strip() for p in (RAW, *parts)) + "\n" + select


def on_issues(select):
    return q(select, NODES, ISSUES)


def on_profile(select):
    return q(select, NODES, ISSUES, STATS, PROFILE)


def on_debt(select, total="true"):
    return q(select, NODES, ISSUES, STATS, WINDOWS, _measures(total))


FIELDS = "rule_id, path, line, severity, message, snippet, suggestion, confidence"
SCAN_ORDER = "path, rule_ord, line, message"
AVG2 = f"{_round('avg_complexity', 2)} AS avg_complexity"
FILE_VALUE = "concat_ws('|', language, lines, code_lines, comment_lines, blank_lines, functions, classes, max_complexity, issue_count)"
LEVEL = "CASE WHEN issue_count > 5 THEN 'high' WHEN issue_count > 2 THEN 'medium' WHEN issue_count > 1 THEN 'low' ELSE 'single' END"


def _dim(names, key):
    values = ", ".join(f"('{n}')" for n in names)
    return (f"SELECT d.{key}, count(i.{key}) AS issues FROM (VALUES {values}) d({key}) "
            f"LEFT JOIN issues i ON i.{key} = d.{key} GROUP BY d.{key}")


RULE_COUNT = "SELECT rule_id || ' ' || rule_name AS rule, count(*) AS issues FROM issues"
PY = "language = 'python'"

ORACLES = {
    "src_files": q(f"SELECT path, md5(content) AS content_md5 FROM code JOIN files USING (path, content)"),
    "src_tree_format": q("SELECT path, strlen(content)::BIGINT AS size, md5(content) AS content_md5 FROM code JOIN files USING (path, content) WHERE path LIKE 'src2/%' AND strlen(content) >= 40"),
    "src_table": q(f"SELECT path, strlen(content)::BIGINT AS n_bytes, ext, {LANGUAGE_CASE} AS language, md5(content) AS content_md5 FROM raw"),
    "filter_extension": q(f"SELECT path FROM raw WHERE ext IN ({SCANNED})"),
    "filter_skip_dirs": q("SELECT path FROM raw WHERE path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/.hidden/%'"),
    "filter_max_size": q("SELECT path FROM raw WHERE strlen(content) <= 4096"),
    "filter_exclude": q("SELECT path FROM raw WHERE " + " AND ".join(
        f"NOT contains('{ROOT}' || path, '{p}')" for p in EXCLUDED)),
    "decode_text": """SELECT doc_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM (
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g') END AS t FROM documents)""",
    "rel_path": q("SELECT path FROM raw"),
    "explode_lines": q(f"SELECT path, language, line_no, line, trim(line, {WS}) AS stripped FROM lines"),
    "detect_language": q(f"SELECT path, {LANGUAGE_CASE} AS language FROM raw"),
    "strip_snippet": q(f"SELECT path, line_no, {SNIP} AS snippet FROM lines"),
    "issue_score": on_issues("SELECT rule_id, path, line, severity, confidence, round(score, 6) AS score FROM issues"),
    "comment_ratio": q("SELECT path, CASE WHEN code_lines = 0 THEN 0.0 ELSE comment_lines / code_lines END::DOUBLE AS comment_ratio "
                       "FROM line_classes", NODES, STATS),
    "normalize_line": q(f"SELECT path, line_no, {_normal(f'trim(line, {WS})')} AS normal FROM lines"),
    "snake_case": q("SELECT path, lineno, name, lower(regexp_replace(name, '([A-Z])', '_\\1', 'g')) AS snake FROM nodes "
                    f"WHERE {FUNCTION}", NODES),
    "line_classes_generic": q(f"SELECT * EXCLUDE (language) FROM line_classes WHERE NOT {PY}", NODES, STATS),
    "line_classes_python": q(f"SELECT * EXCLUDE (language) FROM line_classes WHERE {PY}", NODES, STATS),
    "count_functions": q(f"SELECT path, language, {FUNCTION_COUNT} AS functions FROM files WHERE NOT {PY}"),
    "count_classes": q(f"SELECT path, language, {CLASS_COUNT} AS classes FROM files WHERE NOT {PY}"),
    "py_counts": q(f"SELECT path, functions, classes FROM stats WHERE {PY}", NODES, STATS),
    "py_complexity_stats": q(f"SELECT path, max_complexity, round(avg_complexity, 6) AS avg_complexity FROM stats WHERE {PY}", NODES, STATS),
    "file_stats": on_profile("SELECT * EXCLUDE (score, avg_complexity), round(avg_complexity, 6) AS avg_complexity, "
                             "round(CASE WHEN code_lines = 0 THEN 0.0 ELSE comment_lines / code_lines END::DOUBLE, 6) AS comment_ratio FROM profile"),
    "py_nodes": q("SELECT path, kind, name, lineno, end_lineno, n_args, has_docstring, complexity, walk_seq, visit_seq FROM nodes", NODES),
    "py_cyclomatic": q(f"SELECT path, name, lineno, complexity FROM nodes WHERE {FUNCTION}", NODES),
    "py_last_by_name": q(f"SELECT path, name, lineno, end_lineno, complexity FROM nodes WHERE {FUNCTION} AND last_of_name", NODES),
    "function_locations": q(f"SELECT path, name, lineno, end_lineno, walk_seq FROM nodes WHERE {FUNCTION}", NODES),
    "import_names": q("SELECT path, name, lineno, (path, name) IN (SELECT (path, name) FROM uses) AS used FROM imports", NODES),
    **{r.lower(): q(f"SELECT {FIELDS} FROM issues", *([NODES] if r in NODE_RULES else []), _issues([r])) for r in EMITTED},
    "issues_all": on_issues(f"SELECT rule_name, category, {FIELDS} FROM issues"),
    "dup_windows": q("SELECT path, start_line, array_to_string(block, chr(10)) AS block FROM windows", WINDOWS),
    "dup_low_info": q("SELECT path, start_line FROM telling", WINDOWS),
    "dup_hash": q("SELECT path, start_line, hash FROM hashed", WINDOWS),
    "dup_groups": q("SELECT * FROM groups_flat", WINDOWS),
    "dup_ranked": q("SELECT * FROM groups_flat ORDER BY n_occ DESC, first_path, first_line, hash", WINDOWS),
    "dup_corpus": q("SELECT * FROM groups_flat WHERE (SELECT count(DISTINCT path) FROM files) >= 2", WINDOWS),
    "dup_stats": q("SELECT (SELECT count(*) FROM groups) AS blocks, (SELECT sum(line_count * n_occ)::BIGINT FROM groups) AS duplicated_lines, "
                   "(SELECT count(DISTINCT path) FROM hashed SEMI JOIN groups USING (hash)) AS affected_files", WINDOWS),
    "dup_top_stats": q("SELECT (SELECT count(*) FROM top) AS blocks, (SELECT sum(line_count * n_occ)::BIGINT FROM top) AS duplicated_lines, "
                       "(SELECT count(DISTINCT path) FROM hashed SEMI JOIN top USING (hash)) AS affected_files",
                       WINDOWS, f"top AS ({TOP20})"),
    "dup_occurrences": q("SELECT hash, path, start_line FROM hashed SEMI JOIN groups USING (hash)", WINDOWS),
    "count_by_severity": on_issues(_dim(SEVERITIES, "severity")),
    "count_by_category": on_issues(_dim(CATEGORIES, "category")),
    "count_by_rule": on_issues(f"{RULE_COUNT} GROUP BY rule"),
    "count_by_language": q("SELECT language, count(*) AS files FROM files GROUP BY language"),
    "scan_totals": on_issues("SELECT (SELECT count(*) FROM files) AS files_scanned, count(DISTINCT path) AS files_with_issues, "
                             "count(*) AS total_issues, 0.0::DOUBLE AS elapsed FROM issues"),
    "issues_for_file": on_issues(f"SELECT {FIELDS} FROM issues WHERE path = '{DETAIL_PATH}'"),
    "top_files": on_issues("SELECT f.path, round(coalesce(sum(score), 0), 6)::DOUBLE AS risk_score, count(i.path) AS issue_count "
                           "FROM files f LEFT JOIN issues i ON i.path = f.path GROUP BY f.path ORDER BY risk_score DESC, f.path LIMIT 10"),
    "top_rules": on_issues(f"{RULE_COUNT} GROUP BY rule ORDER BY issues DESC, rule LIMIT 5"),
    "debt_by_severity": on_debt("SELECT replace(kind, 'debt_', '') AS kind, minutes::BIGINT AS minutes FROM (UNPIVOT (SELECT " + ", ".join(
        f"debt_{k}::BIGINT AS debt_{k}" for k in [*SEVERITIES, "complexity", "duplicates"]) +
        " FROM measures) ON COLUMNS('debt_.*') INTO NAME kind VALUE minutes)"),
    "debt_complexity": q("SELECT sum(CASE WHEN max_complexity > 10 THEN (max_complexity - 10) * 10 ELSE 0 END)::BIGINT AS minutes FROM stats",
                         NODES, STATS),
    "debt_duplicates": q("SELECT count(*) * 30 AS minutes FROM groups", WINDOWS),
    "debt_total": on_debt("SELECT total_debt_minutes, total_debt_hours, total_debt_days FROM measures"),
    "debt_formatted": on_debt("SELECT total_debt_minutes, formatted FROM measures"),
    "issues_per_kloc": on_debt("SELECT issues_per_kloc FROM measures"),
    "quality_score": on_debt("SELECT round(score, 6)::DOUBLE AS score, quality_score FROM measures"),
    "grade": on_debt("SELECT grade FROM measures"), "risk_level": on_debt("SELECT risk_level FROM measures"),
    "debt_breakdown": on_debt("SELECT n_security AS security_issues, n_bug AS bug_issues, n_complexity AS complexity_issues, "
                              "n_style AS style_issues, duplicate_blocks, files_with_issues, files_scanned FROM measures"),
    "tech_debt": on_debt("SELECT total_debt_minutes, total_debt_hours, total_debt_days, formatted, debt_critical, debt_high, debt_medium, "
                         "debt_low, debt_info, debt_complexity, debt_duplicates, quality_score, grade, risk_level, issues_per_kloc, "
                         "total_code_lines, n_security AS security_issues, n_bug AS bug_issues, n_complexity AS complexity_issues, "
                         "n_style AS style_issues, duplicate_blocks, files_with_issues, files_scanned FROM measures"),
    "min_severity": on_issues(f"SELECT {FIELDS} FROM issues WHERE severity IN ('critical', 'high', 'medium')"),
    "min_severity_totals": on_debt("SELECT total_issues, n_info, quality_score, grade, issues_per_kloc FROM measures",
                                   "severity IN ('critical', 'high', 'medium')"),
    "gate": on_issues("SELECT *, total_issues > 0 AND critical + high > 0 AS failed FROM (SELECT count(*) FILTER (severity IN "
                      "('critical', 'high', 'medium')) AS total_issues, count(*) FILTER (severity = 'critical') AS critical, "
                      "count(*) FILTER (severity = 'high') AS high FROM issues)"),
    "rules_catalogue": on_issues("SELECT c.*, (SELECT count(*) FROM issues i WHERE i.rule_id = c.rule_id) AS issues FROM (VALUES " + ", ".join(
        f"('{r.rule_id}', {sql_text(r.rule_name)}, '{r.category}', '{r.severity}', {sql_text(r.description)}, "
        f"'{'python' if r.languages else ''}')" for r in RULES.values()) +
        ") c(rule_id, rule_name, category, severity, description, languages)"),
    "summary": q("""
SELECT 'severity' AS section, position::INTEGER AS position, label, n AS value FROM (
  SELECT severity AS label, """ + SEVERITY_ORDER + """ + 1 AS position, count(*) AS n FROM issues GROUP BY ALL)
UNION ALL SELECT 'category', (row_number() OVER (ORDER BY n DESC, list_position(""" + str(CATEGORIES) + """, category)))::INTEGER, category, n
  FROM (SELECT category, count(*) AS n FROM issues GROUP BY category)
UNION ALL SELECT 'file', (row_number() OVER (ORDER BY score DESC, path))::INTEGER, path, issue_count
  FROM (SELECT * FROM profile ORDER BY score DESC, path LIMIT 5)
UNION ALL SELECT 'rule', (row_number() OVER (ORDER BY n DESC, rule))::INTEGER, rule, n
  FROM (SELECT rule_id || ' ' || rule_name AS rule, count(*) AS n FROM issues GROUP BY rule ORDER BY n DESC, rule LIMIT 5)""",
                 NODES, ISSUES, STATS, PROFILE),
    "q_stats": on_debt("SELECT files_scanned, files_with_issues, total_issues, quality_score, grade, risk_level, formatted AS tech_debt, "
                       "total_debt_minutes AS tech_debt_minutes, issues_per_kloc, total_code_lines, 'corpus' AS target, 1.5::DOUBLE AS elapsed FROM measures"),
    "q_issues": on_issues(f"SELECT {FIELDS} FROM issues WHERE severity = 'high' AND contains(path, 'src1') ORDER BY {SCAN_ORDER} LIMIT 200"),
    "q_files": on_profile(f"SELECT path, language, lines, code_lines, comment_lines, functions, classes, max_complexity, {AVG2}, issue_count FROM profile"),
    "q_file_detail": on_profile(f"SELECT path, p.language, lines, code_lines, comment_lines, functions, classes, max_complexity, {AVG2}, "
                                f"i.rule_id, i.severity, i.line, i.message, i.snippet FROM profile p LEFT JOIN issues i USING (path) WHERE path = '{DETAIL_PATH}'"),
    "q_duplicates": q("SELECT t.hash, array_to_string(h.block, chr(10)) AS lines, line_count, n_occ, first_path, first_line FROM top t "
                      "JOIN hashed h ON h.path = t.first_path AND h.start_line = t.first_line", WINDOWS, f"top AS ({TOP20})"),
    "q_top_files": on_profile(f"SELECT path, {_round('score', 1)} AS risk_score, issue_count FROM (SELECT * FROM profile ORDER BY score DESC, path LIMIT 20)"),
    "q_search": on_issues(f"SELECT {FIELDS} FROM issues WHERE severity = 'medium' AND (contains(lower(message), 'sha1 ') OR "
                          f"contains(lower(path), 'sha1 ') OR contains(lower(rule_id), 'sha1 ')) ORDER BY {SCAN_ORDER} LIMIT 300"),
    "q_search_count": on_issues("SELECT count(*) AS issues FROM issues WHERE contains(lower(message), 'f2') OR "
                                "contains(lower(path), 'f2') OR contains(lower(rule_id), 'f2')"),
    "q_security_view": on_issues("SELECT count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER "
                                 "(severity = 'high') AS high, count(DISTINCT path) AS affected_files FROM issues WHERE category = 'security'"),
    "q_security_rules": on_issues(f"{RULE_COUNT} WHERE category = 'security' GROUP BY rule"),
    "q_security_issues": on_issues(f"SELECT {FIELDS} FROM issues WHERE category = 'security' ORDER BY {SCAN_ORDER} LIMIT 100"),
    "q_complexity_view": q("SELECT sum(functions)::BIGINT AS functions, count(*) FILTER (max_complexity > 0) AS files_with_complexity, "
                           "count(*) FILTER (max_complexity > 10) AS high_complexity_files, max(max_complexity) AS max_complexity FROM stats", NODES, STATS),
    "q_complexity_files": on_profile(f"SELECT path, functions, max_complexity, {AVG2}, code_lines FROM (SELECT * FROM profile WHERE max_complexity > 0 "
                                     "ORDER BY max_complexity DESC, issue_count DESC, path LIMIT 50)"),
    "q_complexity_hist": q("SELECT bucket, count(path) AS files FROM (VALUES ('1-5', 1, 5), ('6-10', 6, 10), ('11-20', 11, 20), ('20+', 21, 999999)) "
                           "b(bucket, low, high) LEFT JOIN stats ON max_complexity BETWEEN low AND high GROUP BY bucket", NODES, STATS),
    "q_lines_vs_functions": on_profile("SELECT path, code_lines, functions, issue_count, max_complexity FROM profile WHERE code_lines > 0 "
                                       "ORDER BY issue_count DESC, path LIMIT 50"),
    "q_issue_density": on_profile("SELECT path, density, level FROM (SELECT path, issue_count, floor(d + 0.5)::BIGINT AS density, "
                                  "CASE WHEN d > 20 THEN 'high' WHEN d > 10 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, "
                                  "issue_count / code_lines * 1000 AS d FROM profile WHERE code_lines > 10) "
                                  "ORDER BY density DESC, issue_count DESC, path LIMIT 15)"),
    "q_top_issue_files": on_profile(f"SELECT path, issue_count, {LEVEL} AS level FROM profile WHERE issue_count > 0 ORDER BY issue_count DESC, path LIMIT 10"),
    "q_top_issue_files_30": on_profile(f"SELECT path, issue_count, {LEVEL} AS level FROM profile WHERE issue_count > 0 ORDER BY issue_count DESC, path LIMIT 30"),
    "q_sorted_issues": on_issues(f"SELECT {FIELDS} FROM issues ORDER BY path, line, rule_ord, message"),
    "q_severity_sorted_issues": on_issues(f"SELECT {FIELDS} FROM issues ORDER BY {SEVERITY_ORDER}, path, line, rule_ord, message"),
    "sink_json": q(f"""
SELECT 'summary' AS section, 'all' AS key, concat_ws('|', '', files_scanned, files_with_issues, total_issues, '1.5') AS value FROM measures
UNION ALL SELECT 'severity', severity, issues::VARCHAR FROM ({_dim(SEVERITIES, "severity")})
UNION ALL SELECT 'category', category, issues::VARCHAR FROM ({_dim(CATEGORIES, "category")})
UNION ALL SELECT 'rule', rule, issues::VARCHAR FROM ({RULE_COUNT} GROUP BY rule)
UNION ALL SELECT 'tech_debt', 'all', concat_ws('|', total_debt_minutes, formatted, grade, risk_level, total_code_lines) FROM measures
UNION ALL SELECT 'language', language, count(*)::VARCHAR FROM files GROUP BY language
UNION ALL SELECT 'file', path, {FILE_VALUE} || '|' || round({_round('avg_complexity', 2)} * 100)::BIGINT FROM profile
UNION ALL SELECT 'issue', concat_ws('|', rule_id, path, line), md5(concat_ws('|', rule_name, category, severity, message, snippet, suggestion)) FROM issues
UNION ALL SELECT 'duplicate', g.hash, concat_ws('|', line_count, n_occ, first_path, first_line, md5(array_to_string(h.block, chr(10))))
  FROM groups_flat g JOIN hashed h ON h.path = g.first_path AND h.start_line = g.first_line
UNION ALL SELECT 'place', concat_ws('|', hash, path, start_line), '' FROM hashed SEMI JOIN groups USING (hash)""",
                   NODES, ISSUES, STATS, PROFILE, WINDOWS, _measures("true")),
    "sink_issues_json": on_issues("SELECT rule_id AS rule, severity, path AS file, line, message FROM issues"),
    "sink_tables": q(f"""
SELECT 'rule' AS section, rule AS key, issues::VARCHAR AS value FROM ({RULE_COUNT} GROUP BY rule)
UNION ALL SELECT 'file', path, {FILE_VALUE} FROM profile
UNION ALL SELECT 'duplicate', hash, concat_ws('|', line_count, n_occ, first_path, first_line) FROM groups_flat""", NODES, ISSUES, STATS, PROFILE, WINDOWS),
    "custom_rule": q("""
SELECT 'USR001' AS rule_id, 'Shouting' AS rule_name, path, line_no AS line, 'low' AS severity, 'shouts: ' || line[:4] AS message,
  1.0::DOUBLE AS confidence, 5.0::DOUBLE AS score FROM lines WHERE regexp_matches(line, '^[A-Z]{4,}')
UNION ALL SELECT 'USR002', 'Sparse', path, 1, 'medium', (len(string_split(content, chr(10))) - 1) || ' newlines', 0.5, 10.0
FROM files WHERE language IN ('markdown', 'python') AND len(string_split(content, chr(10) || chr(10))) >= 3
UNION ALL SELECT 'USR003', 'Long', path, 2, 'low', len(string_split(content, chr(10))) || ' lines', 1.0, 5.0
FROM files WHERE len(string_split(content, chr(10))) >= 41"""),
}
