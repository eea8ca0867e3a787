"""Structure facts of Python files.

The one job that needs a Python worker: the standard library parses a file once and gives its
functions, classes and imported names as an array column. Everything built on the facts is plain
column work inside the file's row, so no fact is ever shuffled. Rows of other languages go to the
worker as nulls; their text stays in the JVM.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The functions travel with the job, so executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_TYPE = ("array<struct<kind:string,name:string,lineno:int,end_lineno:int,n_args:int,has_docstring:boolean,"
             "complexity:int,walk_seq:int,visit_seq:int,last_of_name:boolean,used:boolean>>")

_ARROW_TYPE = pa.list_(pa.struct([
    ("kind", pa.string()), ("name", pa.string()), ("lineno", pa.int32()), ("end_lineno", pa.int32()),
    ("n_args", pa.int32()), ("has_docstring", pa.bool_()), ("complexity", pa.int32()), ("walk_seq", pa.int32()),
    ("visit_seq", pa.int32()), ("last_of_name", pa.bool_()), ("used", pa.bool_()),
]))

# Values of nodes without a branch below them.
_PLAIN = frozenset([ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, *ast.expr_context.__subclasses__(),
                    *ast.boolop.__subclasses__(), *ast.operator.__subclasses__(), *ast.unaryop.__subclasses__(),
                    *ast.cmpop.__subclasses__(), int, str, type(None)])
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_ONE_BRANCH = frozenset([ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With])
# Fields that hold statements, in the order of the walk. Definitions and imports stand nowhere else.
_BODIES = {
    **dict.fromkeys([ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.With, ast.AsyncWith, ast.ExceptHandler,
                     ast.match_case], ("body",)),
    **dict.fromkeys([ast.If, ast.For, ast.AsyncFor, ast.While], ("body", "orelse")),
    **dict.fromkeys([ast.Try, ast.TryStar], ("body", "handlers", "orelse", "finalbody")),
    ast.Match: ("cases",),
}


def parse_facts(source: str) -> list[dict]:
    """Facts of one file in walk (breadth-first) order; empty when the file does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    walk = [tree]  # statements only: expressions hold no facts
    for node in walk:
        for name in _BODIES.get(node.__class__, ()):
            walk += getattr(node, name)
    branches, finish = _branch_counts(tree)
    facts = []
    for node in walk:
        if isinstance(node, _FUNCTIONS):
            facts.append(_fact("function", node.name, node, n_args=len(node.args.args) + len(node.args.posonlyargs),
                               has_docstring=bool(ast.get_docstring(node)), complexity=branches[node],
                               visit_seq=finish[node]))
        elif isinstance(node, ast.ClassDef):
            facts.append(_fact("class", node.name, node, has_docstring=bool(ast.get_docstring(node))))
        elif isinstance(node, ast.Import):
            facts += [_fact("import", a.asname or a.name.partition(".")[0], node) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            facts += [_fact("import", a.asname or a.name, node) for a in node.names]
    for seq, fact in enumerate(facts, 1):
        fact["walk_seq"] = seq
    _mark_last(facts, "function", "visit_seq")
    _mark_last(facts, "import", "walk_seq")
    _mark_used(source, [f for f in facts if f["kind"] == "import" and f["last_of_name"]])
    return facts


def _fact(kind, name, node, n_args=0, has_docstring=False, complexity=0, visit_seq=0):
    return {"kind": kind, "name": name, "lineno": node.lineno, "end_lineno": node.end_lineno, "n_args": n_args,
            "has_docstring": has_docstring, "complexity": complexity, "walk_seq": 0, "visit_seq": visit_seq,
            "last_of_name": False, "used": False}


def _branch_counts(tree):
    """Branches per function, and the order in which functions end (inner before outer)."""
    branches, finish = {}, {}
    stack = [(tree, None, False)]
    while stack:
        node, owner, leaving = stack.pop()
        if leaving:
            finish[node] = len(finish) + 1
            continue
        bodies = _BODIES.get(node.__class__, ())
        if isinstance(node, _FUNCTIONS):
            owner = node
            branches[node] = 1
            stack.append((node, None, True))
        if owner is not None:
            branches[owner] += (node.__class__ in _ONE_BRANCH) + _expression_branches(
                [value for name, value in node.__dict__.items() if name not in bodies])
        for name in reversed(bodies):
            stack.extend((child, owner, False) for child in reversed(getattr(node, name)))
    return branches, finish


def _expression_branches(values):
    """Branches in a statement's own expressions."""
    found = 0
    while values:
        value = values.pop()
        kind = value.__class__
        if kind in _PLAIN:
            continue
        if kind is list:
            values += value
            continue
        if kind is ast.BoolOp:
            found += len(value.values) - 1
        elif kind is ast.IfExp:
            found += 1
        if isinstance(value, ast.AST):
            values += value.__dict__.values()
    return found


def _mark_last(facts, kind, order):
    last = {}
    for fact in facts:
        if fact["kind"] == kind and (fact["name"] not in last or fact[order] > last[fact["name"]][order]):
            last[fact["name"]] = fact
    for fact in last.values():
        fact["last_of_name"] = True


def _mark_used(source, imports):
    """A name is used when it stands as a whole word on a line other than its own that does not begin an import."""
    plain = {}
    odd = []
    for fact in imports:
        if re.fullmatch(r"\w+", fact["name"]):
            plain[fact["name"]] = fact
        else:
            odd.append((re.compile(r"\b" + re.escape(fact["name"]) + r"\b"), fact))
    if not plain and not odd:
        return
    own = {fact["lineno"] for fact in imports}
    others = []
    for number, line in enumerate(source.split("\n"), 1):
        if line.strip().startswith(("import", "from")):
            continue
        if number in own:
            _mark_found(line, plain, odd, number)
        else:
            others.append(line)
    _mark_found("\n".join(others), plain, odd)


def _mark_found(part, plain, odd, number=None):
    """Marks the names in some lines, or in the line of that number, where a name's own import doesn't count."""
    for word in plain.keys() & set(re.findall(r"\w+", part)):
        if plain[word]["lineno"] != number:
            plain[word]["used"] = True
    for pattern, fact in odd:
        if fact["lineno"] != number and pattern.search(part):
            fact["used"] = True


def _facts_of(sources: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in sources:
        yield pa.array([None if source is None else parse_facts(source) for source in batch.to_pylist()],
                       type=_ARROW_TYPE)


def facts(language: Column, content: Column) -> Column:
    """Array of node facts of a Python file; null for other languages."""
    # Declared nondeterministic so that the optimizer neither copies the call into filters nor moves it.
    return F.arrow_udf(_facts_of, NODE_TYPE).asNondeterministic()(F.when(language == "python", content))


def nodes(files: DataFrame) -> DataFrame:
    """One row per function, class and imported name of the corpus."""
    found = files.where(F.col("language") == "python").select("path", facts(F.col("language"), F.col("content")).alias("node"))
    return found.select("path", F.inline("node"))


def last_by_name(node_rows: DataFrame) -> DataFrame:
    """Functions after equal names of a file have collapsed to the one that ends last."""
    return node_rows.where((F.col("kind") == "function") & F.col("last_of_name"))


def function_locations(node_rows: DataFrame) -> DataFrame:
    return node_rows.where(F.col("kind") == "function").select("path", "name", "lineno", "end_lineno", "walk_seq")


def import_names(node_rows: DataFrame) -> DataFrame:
    return node_rows.where((F.col("kind") == "import") & F.col("last_of_name")).select("path", "name", "lineno", "used")
