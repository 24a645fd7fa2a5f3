"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch: texts may be long, so few rows, and never a cut text.
ARROW_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def hash_limit(wanted: int, of: int) -> int:
    """The 64-bit hash up to which rows are taken, to take about `wanted` of so many; of any number some."""
    return min((1 << 63) - 1, -(1 << 63) + (1 << 64) * wanted // max(1, of))


#: The columns of row_key.
ROW = ("k", "t", "u")


def row_key(docs: DataFrame, text: str, key: str) -> list[Column]:
    """What tells rows apart where ids may be null or occur twice: the id and two hashes of the text."""
    return [docs[key].alias("k"), F.xxhash64(docs[text]).alias("t"), F.hash(docs[text]).alias("u")]


def same_row(a: DataFrame, b: DataFrame, columns=ROW) -> Column:
    """Whether rows of a and b agree in the columns; nulls are equal."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, even inside higher-order functions."""
    return F.transform(F.array(value), body)[0]
