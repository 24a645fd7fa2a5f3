"""Composition of a corpus from parts: sizes and overlaps, balance of classes, overrides, row ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composition(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(role, n_rows, n_keys, n_shared) of every part that has rows; n_shared keys are in another part too.

    Copies of a key collapse before the shuffle; what is collected for a key is bounded by the number of
    parts. Null keys count as rows only."""
    rows = reduce(DataFrame.unionAll, [df.select(F.lit(role).alias("role"), F.col(key).alias("key")) for role, df in parts.items()])
    by_key = rows.groupBy("role", "key").agg(F.count("*").alias("n"))
    roles = by_key.groupBy("key").agg(F.collect_list(F.struct("role", "n")).alias("found"))
    known = F.col("key").isNotNull()
    return (
        roles.select("key", (F.size("found") > 1).alias("shared"), F.inline("found"))
        .groupBy("role")
        .agg(F.sum("n").alias("n_rows"), F.count_if(known).alias("n_keys"), F.count_if(known & F.col("shared")).alias("n_shared"))
    )


def balance(df: DataFrame, group: str, by: str, values) -> DataFrame:
    """(group, n, n_<value> ..., spread) with one count for each value; spread is the largest count less the smallest.

    The values are configuration, so one aggregate makes all counts; other and null values count in n alone."""
    counts = [F.count_if(F.col(by) == v).alias(f"n_{v}") for v in values]
    names = [F.col(f"n_{v}") for v in values]
    spread = F.greatest(*names) - F.least(*names) if len(names) > 1 else F.lit(0).cast("long")
    return df.groupBy(group).agg(F.count("*").alias("n"), *counts).withColumn("spread", spread)


def override(df: DataFrame, replacements: DataFrame, key: str, column: str) -> DataFrame:
    """df with column taken from replacements (key, column; one row a key) where they have a value for the key."""
    new = replacements.select(F.col(key).alias("_replaced_key"), F.col(column).alias("_replacement"))
    joined = df.join(new, df[key] == F.col("_replaced_key"), "left")
    return joined.withColumn(column, F.coalesce("_replacement", column)).select(*df.columns)


def with_uuid(df: DataFrame, name: str = "uuid") -> DataFrame:
    """A random id for each row; write the table before it is read twice."""
    return df.withColumn(name, F.uuid())


def yaml_of(df: DataFrame, *columns: str) -> Column:
    """A row's columns as YAML text, one `name: value` a line; strings are quoted and lists in flow style."""
    value = lambda c: F.regexp_extract(F.to_json(F.array(df[c])), r"(?s)^\[(.*)\]$", 1)
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), value(c)) for c in columns or df.columns])
