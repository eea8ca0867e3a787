"""The rule catalogue: one entry per rule and one finding per way a rule can fire.

A finding has a numeric code (``10 * rule order + variant``). Detection gives codes; everything that
is the same for all hits of a finding is attached later from this small fixed table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corpusaudit import dims


@dataclass(frozen=True)
class Finding:
    message: str
    severity: str
    pattern: str = ""
    # Literals (lower case) of which one must stand in the case-folded line for the pattern to match: a cheap
    # test before it. None holds the letter i, whose dotted capital folds to two characters.
    hints: tuple[str, ...] = ()
    # Further characters that must all stand in the line; q stands for either quote.
    needs: str = ""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_name: str
    category: str
    severity: str
    description: str
    suggestion: str
    confidence: float
    findings: tuple[Finding, ...]
    languages: tuple[str, ...] = ()
    order: int = field(default=0)

    def code(self, variant: int = 1) -> int:
        return self.order * 10 + variant


_PY = ("python",)

# --- fixed values: rules, patterns, messages --------------------------------------------------

_RULES = [
    Rule("SEC001", "Hardcoded Secrets", "security", "critical",
         "Detects hardcoded passwords, API keys, tokens, and private keys.",
         "Move secrets to environment variables or a secure vault.", 0.9, (
             Finding("Hardcoded password detected", "critical",
                     r'(?i)(password|passwd|pwd)\s*[:=]\s*["\'][^"\']{4,}["\']',
                     ("password", "passwd", "pwd"), "q"),
             Finding("Hardcoded API key or token detected", "critical",
                     r'(?i)(api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*["\'][A-Za-z0-9_\-]{8,}["\']',
                     ("key", "token"), "q"),
             Finding("Hardcoded private key detected", "critical",
                     r'(?i)(private[_-]?key|secret)\s*[:=]\s*["\']-----BEGIN',
                     ("-----beg",), "q"),
             Finding("AWS access key ID detected", "critical", r'AKIA[0-9A-Z]{16}', ("akia",)),
             Finding("GitHub token detected", "critical", r'gh[pousr]_[A-Za-z0-9]{36}',
                     ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "_"),
             Finding("API secret key detected", "critical", r'sk_[A-Za-z0-9]{20,}', ("sk_",), "_"),
             Finding("Database connection string with credentials detected", "high",
                     r'(?i)(db[_-]?url|database[_-]?url|connection[_-]?string)\s*+[:=]\s*+["\'][^"\':]*+:[^"\'@]*+@',
                     ("url", "connect"), "@q"),
             Finding("Hardcoded JWT token detected", "high",
                     r'(?i)(jwt|json[_-]web[_-]?token)\s*[:=]\s*["\']eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+["\']',
                     ("eyj",), "q"),
         )),
    Rule("SEC002", "SQL Injection", "security", "high",
         "Detects potential SQL injection via string concatenation in queries.",
         "Use parameterized queries (e.g., execute('SELECT * WHERE id = ?', (id,))).", 0.7, (
             Finding("SQL query built with string concatenation — possible SQL injection", "high",
                     r'(?i)(execute|cursor\.execute|db\.query)\s*\(\s*["\'][^"\']*["\']\s*\+',
                     ("execute", "db.query"), "(+q"),
             Finding("SQL query built with f-string — possible SQL injection", "high",
                     r'(?i)(execute|cursor\.execute)\s*\(\s*f["\']', ("execute",), "(q"),
             Finding("SQL query built with % formatting — possible SQL injection", "high",
                     r'(?i)^(?>.*?execute\s*+\(\s*+["\'][^"\']*?%\s*+\().*\)', ("execute",), "%()q"),
             Finding("Dynamic SQL with concatenation — possible SQL injection", "high",
                     r'(?i)^(?>.*?SELECT)(?>.*?FROM).*?\+\s*+\w', ("select",), "+"),
         )),
    Rule("SEC003", "Command Injection", "security", "high",
         "Detects potential command injection via shell=True, eval, exec, and string-built commands.",
         "Use subprocess with argument lists and shell=False. Avoid eval/exec on untrusted input.", 0.8, (
             Finding("Shell command built with concatenation — possible command injection", "high",
                     r'(?i)(?:os\.system|subprocess\.(?:call|run|Popen))\s*+\((?:\s*+["\'])?+'
                     r'(?:(?!(?:os\.system|subprocess\.(?:call|run|Popen))\s*+\()[^"\'+])*+(?:\+|["\']\s*+\+)',
                     ("os.system", "subprocess."), "(+"),
             Finding("Shell command built with f-string — possible command injection", "high",
                     r'(?i)(os\.system|subprocess\.(call|run))\s*\(\s*f["\']', ("os.system", "subprocess."), "("),
             Finding("shell=True enables command injection risks", "high",
                     r'(?i)shell\s*=\s*True', ("shell",), "="),
             Finding("Use of eval() — potential code injection", "critical", r'(?i)eval\s*\(', ("eval",), "("),
             Finding("Use of exec() — potential code injection", "critical", r'(?i)exec\s*\(', ("exec",), "("),
         )),
    Rule("SEC004", "Insecure Deserialization", "security", "high",
         "Detects unsafe deserialization of untrusted data.",
         "Use json for untrusted data, or yaml.safe_load. Never deserialize untrusted pickled data.", 0.85, (
             Finding("pickle.load(s) on untrusted data — arbitrary code execution risk", "high",
                     r'(?i)pickle\.loads?\s*\(', ("ckle.load",), "("),
             Finding("yaml.load without SafeLoader — arbitrary code execution risk", "high",
                     r'(?i)yaml\.load\s*+\((?:(?!yaml\.load\s*+\()[^)])*+\)'
                     r'(?:(?!Loader|yaml\.load\s*+\((?:(?!yaml\.load\s*+\()[^)])*+\)).)*+$', ("yaml.load",), "()"),
             Finding("marshal.load(s) — unsafe for untrusted data", "high",
                     r'(?i)marshal\.loads?\s*\(', ("marshal.load",), "("),
             Finding("shelve.open — unsafe for untrusted data", "high",
                     r'(?i)shelve\.open\s*\(', ("shelve.open",), "("),
         )),
    Rule("SEC005", "Weak Cryptography", "security", "medium",
         "Detects use of weak or broken cryptographic algorithms.",
         "Use SHA-256 or stronger for hashing, AES for encryption, and secrets module for random values.", 0.75, (
             Finding("MD5 is cryptographically broken", "high", r'(?i)(hashlib\.)?md5\s*\(', ("md5",), "("),
             Finding("SHA1 is considered weak for security purposes", "medium",
                     r'(?i)(hashlib\.)?sha1\s*\(', ("sha1",), "("),
             Finding("DES is insecure and broken", "high", r'(?i)DES\b', ("des",)),
             Finding("RC4 is insecure and broken", "medium", r'(?i)RC4\b', ("rc4",)),
             Finding("random.random() is not cryptographically secure — use secrets module", "medium",
                     r'(?i)random\.random\s*\(\)', ("random.random",), "("),
             Finding("random.randint() is not cryptographically secure — use secrets module", "medium",
                     r'(?i)random\.randint\s*\(', ("random.rand",), "("),
         )),
    Rule("SEC006", "Hardcoded Endpoints", "security", "low",
         "Detects hardcoded URLs and IP addresses that should be configurable.",
         "Move endpoints to configuration or environment variables.", 0.6, (
             Finding("Hardcoded IP address or URL — should be configurable", "low",
                     r'["\']https?://(?:\d{1,3}\.){3}\d{1,3}[:/]?[^"\']*["\']|["\'](?:\d{1,3}\.){3}\d{1,3}["\']',
                     (), ".q"),
         )),
    Rule("BUG001", "Bare Except", "bug", "medium",
         "Detects bare except clauses that swallow all exceptions.",
         "Specify exception types: except (ValueError, KeyError) as e:", 0.95, (
             Finding("Bare except clause catches all exceptions including KeyboardInterrupt", "medium",
                     r'^\s*except\s*:', ("except",), ":"),
         ), _PY),
    Rule("BUG002", "Mutable Default Argument", "bug", "high",
         "Detects mutable default arguments in function definitions.",
         "Use None as default and initialize inside: if x is None: x = []", 0.9, (
             Finding("Mutable default argument — shared across all calls", "high",
                     r'def\s+\w+\s*\([^)]*=\s*(\[\]|\{\}|set\(\)|dict\(\)|list\(\))', ("def",), "(="),
         ), _PY),
    Rule("BUG003", "Comparison with None", "bug", "low",
         "Detects use of == or != instead of is/is not for None comparisons.",
         "Use identity comparison: if x is None:", 0.85, (
             Finding("Use 'is None' or 'is not None' instead of ==/!=", "low",
                     r'==\s*None|!=\s*None', ("none",), "="),
         ), _PY),
    Rule("BUG004", "Unused Import", "maintainability", "info",
         "Detects potentially unused imports (heuristic).",
         "Remove unused imports to keep code clean.", 0.6,
         (Finding("Potentially unused import: ", "info"),), _PY),
    Rule("BUG005", "Print in Production", "maintainability", "info",
         "Detects print() statements that should use logging.",
         "Use logging.info/debug/warning instead of print().", 0.5, (
             Finding("print() statement — consider using logging for production code", "info",
                     r'^\s*print\s*\(', ("print",), "("),
         ), _PY),
    Rule("BUG006", "TODO/FIXME Comments", "maintainability", "info",
         "Detects TODO, FIXME, HACK, and XXX comments.",
         "Resolve or create an issue ticket for this marker.", 1.0, (
             Finding("Unresolved marker in comment: ", "info",
                     r'(?i)(TODO|FIXME|HACK|XXX|BUG)\s*[:\s]', ("todo", "xme", "hack", "xxx", "bug")),
         )),
    Rule("BUG007", "Broad Exception Catch", "bug", "low",
         "Detects catching Exception (too broad).",
         "Catch specific exception types instead of Exception.", 0.7, (
             Finding("Catching Exception is too broad — may hide bugs", "low",
                     r'^\s*except\s+Exception\s*:', ("except",), ":"),
         ), _PY),
    Rule("CPX001", "High Cyclomatic Complexity", "complexity", "medium",
         "Detects functions with high cyclomatic complexity (> 10).",
         "Break the function into smaller, more focused functions.", 0.95,
         (Finding("", "high"), Finding("", "medium")), _PY),
    Rule("CPX002", "Long Function", "complexity", "low",
         "Detects functions that are too long (> 50 lines).",
         "Extract helper functions to reduce length.", 0.9,
         (Finding("", "medium"), Finding("", "low")), _PY),
    Rule("CPX003", "Deep Nesting", "complexity", "medium",
         "Detects deeply nested code blocks (> 4 levels).",
         "Use early returns, guard clauses, or extract methods to reduce nesting.", 0.8,
         (Finding("", "medium"),), _PY),
    Rule("CPX004", "Too Many Arguments", "complexity", "low",
         "Detects functions with too many parameters (> 5).",
         "Group related parameters into a data class or dictionary.", 0.85,
         (Finding("", "low"),), _PY),
    Rule("CPX005", "File Too Large", "complexity", "low",
         "Detects files that exceed 500 lines.",
         "Consider splitting this file into smaller modules.", 0.9,
         (Finding("", "medium"), Finding("", "low"))),
    Rule("STY001", "Line Too Long", "style", "info",
         "Detects lines exceeding 120 characters.",
         "Break long lines for readability.", 1.0, (Finding("", "info"),)),
    Rule("STY002", "Trailing Whitespace", "style", "info",
         "Detects trailing whitespace at end of lines.",
         "Remove trailing whitespace.", 1.0, (Finding("Trailing whitespace", "info"),)),
    Rule("STY003", "Mixed Indentation", "style", "low",
         "Detects mixed tabs and spaces for indentation.",
         "Use spaces consistently (PEP 8 recommends 4 spaces).", 0.9,
         (Finding("Mixed tabs and spaces for indentation", "low"),)),
    Rule("STY004", "Missing Docstring", "style", "info",
         "Detects public functions/classes without docstrings.",
         "Add a docstring describing purpose, parameters, and return value.", 0.7,
         (Finding("", "info"),), _PY),
    Rule("STY005", "Non-snake_case Variable", "style", "info",
         "Detects variables/functions using camelCase instead of snake_case.",
         "", 0.6, (Finding("", "info"),), _PY),
    Rule("DUP001", "Duplicate Code", "duplicate", "low",
         "Detects duplicated code blocks across the codebase.", "", 1.0, ()),
]

COMPLEXITY_THRESHOLD, HIGH_COMPLEXITY = 10, 20
FUNCTION_LINES_THRESHOLD, LONG_FUNCTION_LINES = 50, 100
NESTING_THRESHOLD = 4
ARGUMENTS_THRESHOLD = 5
FILE_LINES_THRESHOLD, LARGE_FILE_LINES = 500, 1000
LINE_LENGTH_THRESHOLD = 120

# --- end of fixed values ----------------------------------------------------------------------

RULES: dict[str, Rule] = {
    rule.rule_id: Rule(**{**rule.__dict__, "order": i}) for i, rule in enumerate(_RULES, 1)
}

FINDING_SCHEMA = ("code int, rule_ord int, rule_id string, rule_name string, category string, severity string, "
                  "weight int, severity_ord int, message string, suggestion string, confidence double")


def finding_rows(rules) -> list[tuple]:
    return [(rule.code(variant), rule.order, rule.rule_id, rule.rule_name, rule.category, f.severity,
             dims.SEVERITY_WEIGHT[f.severity], dims.SEVERITY_ORDER[f.severity], f.message, rule.suggestion,
             rule.confidence)
            for rule in rules for variant, f in enumerate(rule.findings, 1)]


def findings(spark: SparkSession, extra=()) -> DataFrame:
    """One row per finding code; always small enough to broadcast (the catalogue plus the user's rules)."""
    return dims.local_frame(spark, FINDING_SCHEMA, finding_rows([*RULES.values(), *extra]))


def rules_catalogue(spark: SparkSession, category: str | None = None, rule_id: str | None = None,
                    extra=()) -> DataFrame:
    """Catalogue rows in (category, rule id) order, optionally of one category or one id."""
    rows = [(r.rule_id, r.rule_name, r.category, r.severity, r.description, list(r.languages))
            for r in [*RULES.values(), *extra]]
    frame = dims.local_frame(
        spark, "rule_id string, rule_name string, category string, severity string, description string, "
               "languages array<string>", rows)
    if category is not None:
        frame = frame.where(frame.category == category)
    if rule_id is not None:
        frame = frame.where(frame.rule_id == rule_id)
    return frame.orderBy("category", "rule_id")
