"""Corpus curation: filters, exact deduplication, anti-filters, composition checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.python_code import documented_function
from quillon.functions.text import first_usable, safe_number, usable_text

CONTAMINATION = 0.75


def uncontaminated(similarity: Column, limit: float = CONTAMINATION) -> Column:
    """A known similarity that is not limit or more; NaN is neither and stays."""
    return similarity.isNotNull() & (F.isnan(similarity) | (similarity < limit))


def similarity_of(df: DataFrame, names=("benchmark_similarity", "Benchmark_similarity")) -> Column:
    """The first non-null alias as a number; if that does not parse, null: later aliases are not tried."""
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return safe_number(F.coalesce(*found)) if found else F.lit(None).cast("double")


def filter_solutions(df: DataFrame, limit: float = CONTAMINATION) -> DataFrame:
    """Rows that are not contaminated and hold one documented function; the parse comes last."""
    solution = first_usable(df, ("solution", "Solution"), lambda c: c)
    cheap = df.filter(uncontaminated(similarity_of(df), limit) & solution.isNotNull())
    return cheap.filter(documented_function(solution))


def dedup_keep_first(df: DataFrame, content: str, order: str) -> DataFrame:
    """One row for each content, the one that comes first by order (null last), then by a hash of the row; nulls are one content.

    A partial aggregate keeps a content's first row, so one with many copies is reduced before the shuffle."""
    row = F.struct(*[c for c in df.columns if c != content])
    first = F.min_by(row, F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("order"), F.xxhash64(*df.columns).alias("hash"))).alias("_row")
    out = df.groupBy(F.col(content).alias("_content")).agg(first)
    return out.select(*[F.col("_content").alias(c) if c == content else F.col("_row")[c].alias(c) for c in df.columns])


def duplicate_groups(df: DataFrame, content: str, key: str) -> DataFrame:
    grouped = df.groupBy(content).agg(F.min(key).alias("first_id"), F.count("*").alias("n_copies"))
    return grouped.filter("n_copies > 1").select("first_id", "n_copies")


def drop_failed(df: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key has not failed; a null key never matches, so such rows stay."""
    return df.join(failed.select(key).distinct(), key, "left_anti")


def usable_id(df: DataFrame) -> Column:
    return first_usable(df, ("id", "ID", "uuid", "UUID"), usable_text)


def containment(docs: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, similarity): the largest share of a benchmark item's n-word shingles found in a document.

    An inverted index over the items' shingles meets the documents' distinct shingles in one equi-join;
    documents without a shared shingle have no row."""
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " ")
    shingles = lambda df, key: df.select(key, words(F.col("text")).alias("w")).filter(F.size("w") >= n).select(
        key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))).alias("s")
    )
    wanted = shingles(items, "item_id")
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("size"))
    hits = shingles(docs, "doc_id").join(wanted, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"))
    return hits.join(sizes, "item_id").groupBy("doc_id").agg(F.max(F.col("hits") / F.col("size")).alias("similarity"))


def replicate(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def counts_with_default(df: DataFrame, *columns: str, missing: str = "missing") -> DataFrame:
    return df.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns]).agg(F.count("*").alias("n"))
