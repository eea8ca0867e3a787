"""Fixed dimensions: severities, categories, file extensions, languages and skipped directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------------------------

# (severity, weight, order, minutes to fix)
SEVERITIES = [
    ("critical", 100, 0, 120),
    ("high", 50, 1, 60),
    ("medium", 20, 2, 20),
    ("low", 5, 3, 5),
    ("info", 1, 4, 1),
]

CATEGORIES = ["security", "bug", "complexity", "style", "duplicate", "maintainability"]

SCAN_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".h", ".cpp", ".cc", ".hpp", ".cs", ".go",
    ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".bash", ".sql", ".html", ".htm",
    ".css", ".scss", ".less", ".json", ".yaml", ".yml", ".xml", ".toml", ".ini", ".cfg", ".r",
    ".lua", ".pl", ".dart", ".md",
]

SKIP_DIRS = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "env", "build", "dist", ".idea",
    ".vscode", ".tox", ".mypy_cache", ".pytest_cache", "coverage", "htmlcov", ".next", ".nuxt",
    "target", "bin", "obj", "packages", ".dart_tool",
]

MAX_FILE_SIZE = 1024 * 1024

EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".sh": "shell",
    ".bash": "shell",
    ".sql": "sql",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "sass",
    ".less": "less",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".xml": "xml",
    ".md": "markdown",
    ".toml": "toml",
    ".ini": "ini",
    ".cfg": "ini",
    ".r": "r",
    ".lua": "lua",
    ".pl": "perl",
    ".dart": "dart",
}

LINE_COMMENT_LANGUAGES = {
    "#": ["python", "shell", "ruby", "perl", "r"],
    "//": ["javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "php", "swift",
           "kotlin", "scala"],
    "--": ["sql", "lua"],
}

BLOCK_COMMENT_LANGUAGES = [
    "c", "cpp", "java", "javascript", "typescript", "csharp", "go", "rust", "php", "swift",
    "kotlin", "scala",
]

# --- end of fixed values ----------------------------------------------------------------------

SEVERITY_WEIGHT = {name: weight for name, weight, _, _ in SEVERITIES}
SEVERITY_ORDER = {name: order for name, _, order, _ in SEVERITIES}
FIX_MINUTES = {name: minutes for name, _, _, minutes in SEVERITIES}


def local_frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A literal table that the optimizer sees as a local relation (a few dozen rows, never more)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [[] for _ in target]
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, target)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=target))


def dim_severity(spark: SparkSession) -> DataFrame:
    return local_frame(spark, "severity string, weight int, ord int, fix_minutes int", SEVERITIES)


def dim_category(spark: SparkSession) -> DataFrame:
    return local_frame(spark, "category string, ord int",
                       [(name, i) for i, name in enumerate(CATEGORIES)])

