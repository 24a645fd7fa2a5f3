"""Text functions as column expressions: tokens, previews, cleaning, extraction and parsing."""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """White-space tokens of a text; null is empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def preview(text: Column, length: int = 120) -> Column:
    """White space collapsed, cut to some code points."""
    return F.substring(F.array_join(tokens(text), " "), 1, length)


def strip_keywords(code: Column, unicode: bool = True) -> Column:
    """Code without decorators, dunder names and Python keywords, and the white space they leave tidied.

    It works on text, so it also reaches strings, comments and e-mail domains. Words are made of letters of
    any script, or of ASCII letters alone."""
    words = "|".join(sorted(keyword.kwlist))
    flags, edge = ("(?U)", (r"\b", r"\b")) if unicode else ("", (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"))
    out = F.regexp_replace(code, rf"{flags}(?s)@\w+(\.\w+)*(\(.*?\))?", "")
    for pattern, put in ((rf"{edge[0]}__\w+__{edge[1]}", ""), (rf"{edge[0]}({words}){edge[1]}", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", "")):
        out = F.regexp_replace(out, flags + pattern, put)
    return out


def slug(name: Column) -> Column:
    """A name for files: runs of other characters become --, an empty name becomes adapter."""
    out = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"^[./]+|[./]+$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[^A-Za-z0-9._-]+", "--"), r"^-+|-+$", "")
    return F.when(out == "", F.lit("adapter")).otherwise(out)


def path_safe(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("__"))


def usable_text(column: Column) -> Column:
    return F.when(not_blank(column), column)


def truthy(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def first_usable(df: DataFrame, names, usable=truthy, default: str | None = None) -> Column:
    """The first usable value among those of the named columns that df has; chosen when the plan is made."""
    found = [usable(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")


def safe_number(column: Column) -> Column:
    """A number as Python's float() reads it, else null; white space around it is allowed."""
    return F.regexp_replace(column.cast("string"), r"^\s+|\s+$", "").try_cast("double")


def needs_test_runner(code: Column) -> Column:
    """Whether test code relies on a test framework."""
    return code.contains("def test_") | code.contains("class Test") | code.contains("pytest") | code.contains("unittest")


def program_of(code: Column, prompt: Column, solution: Column) -> Column:
    """A whole program: given code, or a complete solution, or the prompt continued by the solution."""
    body = F.regexp_replace(solution, r"^\s+", "")
    whole = body.startswith("class ") | body.startswith("def ")
    joined = F.concat(F.regexp_replace(prompt, r"\s+$", ""), F.lit("\n"), F.regexp_replace(solution, r"^\n+", ""))
    return F.when(truthy(code).isNotNull(), code).when(whole, solution).otherwise(joined)


def test_module(entry_point: Column, test: Column) -> Column:
    """Test code wrapped so that a test runner finds its check of entry_point."""
    return F.concat(F.lit("from solution import "), entry_point, F.lit("\n\n"), test, F.lit("\n\n\ndef test_all():\n    check("), entry_point, F.lit(")\n"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
TOKEN = r"token = \"([0-9a-f]{40})\""


def task_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def difficulty_bucket(complexity: Column) -> Column:
    return (
        F.when((complexity >= 1) & (complexity <= 10), "simple")
        .when((complexity > 10) & (complexity <= 20), "moderate")
        .when((complexity > 20) & (complexity <= 50), "complex")
        .otherwise("out-of-range")
    )
