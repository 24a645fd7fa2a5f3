"""Sinks: JSON lines and reports, formatted CSV, id lists, Markdown of small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One record for each row; null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_json(df: DataFrame) -> str:
    """A small result as one JSON array."""
    return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()) + "]"


def formatted(df: DataFrame, **formats: str) -> DataFrame:
    """Numbers as text: formatted(df, score="%.4f")."""
    return df.select(*[F.format_string(formats[c], F.col(c)).alias(c) if c in formats else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, **formats: str) -> None:
    formatted(df, **formats).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_id_list(df: DataFrame, key: str, path: str) -> None:
    """Sorted ids, one on a line; range-partitioned files in order."""
    df.select(F.col(key).cast("string").alias("value")).filter("value IS NOT NULL").orderBy("value").write.mode("overwrite").text(path)


def markdown_table(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in df.toLocalIterator()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"
