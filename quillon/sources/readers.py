"""Sources: splits, JSON lines with line numbers, JSON arrays, CSV, vectors, checkpoint listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import require_columns


def read_split(spark: SparkSession, splits: dict[str, str], split: str | None = None, prefer: str | None = None) -> DataFrame:
    """A named split, or a preferred one, or the only one, or all of them in one."""
    if split is not None:
        if split not in splits:
            raise ValueError(f"no split {split!r}; available: {sorted(splits)}")
        return spark.read.parquet(splits[split])
    if prefer is not None:
        return spark.read.parquet(splits.get(prefer, next(iter(splits.values()))))
    frames = [spark.read.parquet(p) for p in splits.values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with their line number from 1; a bad line is a row with _json_error, a blank line none.

    Line numbers need a file's lines in order, so each file is read whole by one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("at", "line"))
    kind = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_json_error", T.StringType())])
    parsed = F.from_json("line", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_json_error"})
    return files.filter(F.col("line").rlike(r"\S")).select("file", (F.col("at") + 1).alias("line_number"), parsed.alias("r")).select("file", "line_number", "r.*")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character that is not white space; bad JSON raises."""
    first = spark.read.text(path).filter(F.col("value").rlike(r"\S")).select(F.substring(F.trim("value"), 1, 1)).limit(1).collect()
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", bool(first) and first[0][0] == "[")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def checked_vectors(df: DataFrame, texts: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """df, after its rows were counted against texts and its components looked through for NaN."""
    require_columns(df, key, vector)
    row = df.agg(F.count("*").alias("n"), F.sum(F.exists(vector, lambda x: F.isnan(x)).cast("long")).alias("bad")).first()
    if row["n"] != texts.count():
        raise ValueError(f"{row['n']} vectors for another number of texts")
    if row["bad"]:
        raise ValueError(f"{row['bad']} vectors hold NaN")
    return df


def list_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files below a folder, relative to it, listed by Spark's own file index."""
    root = path.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.select(F.regexp_replace("path", rf"^.*?{root.rsplit('/', 1)[-1]}/", "").alias("path"))
