"""Checks of Python source as Arrow-batched functions: parsing has no column expression."""

from __future__ import annotations

import ast
import re
import statistics
import sys

import pandas as pd
from pyspark.sql import functions as F

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_STDLIB = frozenset(sys.stdlib_module_names) | frozenset(sys.builtin_module_names)


def is_standard_module(name: str) -> bool:
    return name.partition(".")[0] in _STDLIB


def _imports_standard(node: ast.AST) -> bool:
    """from . import x names no module and is refused; a level is not looked at otherwise."""
    if isinstance(node, ast.Import):
        names = [a.name for a in node.names]
    elif isinstance(node, ast.ImportFrom):
        names = [node.module]
    else:
        return True
    return all(n is not None and is_standard_module(n) for n in names)


def is_documented_function(source) -> bool:
    """Imports and one undecorated function with a plain triple-quoted docstring, all imports standard."""
    if not isinstance(source, str) or not source.strip():
        return False
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    functions = [n for n in tree.body if isinstance(n, _FUNCTIONS)]
    others = [n for n in tree.body if not isinstance(n, (*_FUNCTIONS, ast.Import, ast.ImportFrom))]
    if others or len(functions) != 1 or functions[0].decorator_list:
        return False
    if not (ast.get_docstring(functions[0]) or "").strip():
        return False
    quoted = (ast.get_source_segment(source, functions[0].body[0]) or "").lstrip()
    return quoted.startswith(('"' * 3, "'" * 3)) and all(map(_imports_standard, ast.walk(tree)))


def compile_check(source) -> dict:
    """valid, error_type, error_message, lineno, offset."""
    error, place = None, (None, None)
    if not isinstance(source, str):
        return {"valid": False, "error_type": "TypeError", "error_message": f"expected str, got {type(source).__name__}", "lineno": None, "offset": None}
    try:
        compile(source, "<row>", "exec")
    except SyntaxError as e:
        error, place = (type(e).__name__, e.msg), (e.lineno, e.offset)
    except Exception as e:  # noqa: BLE001
        error = (type(e).__name__, str(e))
    kind, message = error or (None, None)
    return {"valid": error is None, "error_type": kind, "error_message": message, "lineno": place[0], "offset": place[1]}


_BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.comprehension)


def complexity(node: ast.AST) -> int:
    """1 and every branch, boolean operand, comprehension condition and match case below node."""
    total = 1
    for n in ast.walk(node):
        if isinstance(n, _BRANCHES):
            total += 1 + (len(n.ifs) if isinstance(n, ast.comprehension) else 0)
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.Match):
            total += sum(not (isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None) for c in n.cases)
    return total


def complexity_report(source, kind) -> dict:
    """average, status and details (name, cc): a function's first block, a class's methods but __init__, or all."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"average": None, "status": "error", "reason": f"{type(e).__name__}: {e}", "details": []}
    functions = [n for n in tree.body if isinstance(n, _FUNCTIONS)]
    methods = [(c.name, m) for c in tree.body if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, _FUNCTIONS)]
    if kind == "function":
        chosen = [(f.name, f) for f in functions[:1]]
    elif kind == "class":
        chosen = [(f"{c}.{m.name}", m) for c, m in methods if m.name != "__init__"]
    else:
        chosen = [(f.name, f) for f in functions] + [(f"{c}.{m.name}", m) for c, m in methods]
    if not chosen:
        return {"average": None, "status": "error", "reason": "no block to measure", "details": []}
    details = [{"name": n, "cc": complexity(f)} for n, f in chosen]
    return {"average": round(statistics.mean(d["cc"] for d in details), 2), "status": "ok", "reason": None, "details": details}


def entry_point(source, indented: bool) -> str | None:
    """The first top-level class or function; failing that by pattern, at any indent or at column 0 only."""
    if not isinstance(source, str):
        return None
    try:
        for n in ast.parse(source).body:
            if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
                return n.name
    except (SyntaxError, ValueError, RecursionError):
        pass
    m = re.search(r"^\s*(?:class|def)\s+([A-Za-z_]\w*)" if indented else r"^(?:def|class)\s+(\w+)", source, re.MULTILINE)
    return m[1] if m else None


def arrow_function(returns: str):
    """A batch function as a function of columns; the session is only needed where a plan is made."""

    def wrap(function):
        def call(*columns):
            return F.pandas_udf(function, returns)(*columns)

        call.__doc__ = function.__doc__
        return call

    return wrap


@arrow_function("boolean")
def documented_function(source: pd.Series) -> pd.Series:
    return source.map(is_documented_function)


@arrow_function("valid boolean, error_type string, error_message string, lineno int, offset int")
def syntax_report(source: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([compile_check(s) for s in source], columns=["valid", "error_type", "error_message", "lineno", "offset"])
    return out.astype({"lineno": "Int32", "offset": "Int32"})


@arrow_function("average double, status string, reason string, details array<struct<name:string,cc:int>>")
def complexity_of(source: pd.Series, kind: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([complexity_report(s, k) for s, k in zip(source, kind, strict=True)], columns=["average", "status", "reason", "details"])


@arrow_function("string")
def entry_point_anywhere(source: pd.Series) -> pd.Series:
    return source.map(lambda s: entry_point(s, True))


@arrow_function("string")
def entry_point_at_margin(source: pd.Series) -> pd.Series:
    return source.map(lambda s: entry_point(s, False))
