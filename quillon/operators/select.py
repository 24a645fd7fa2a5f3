"""Choice among configurations: validity, min-max scores, the best row, the Pareto frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_configs(grid: DataFrame, *scores: str, topics: str | None = None, least: int = 0, most: int | None = None) -> DataFrame:
    """Rows whose scores are numbers and whose number of topics is in range; none is an error for the caller."""
    keep = F.lit(True)
    for s in scores:
        keep = keep & F.col(s).isNotNull() & ~F.isnan(s)
    if topics:
        keep = keep & (F.col(topics) >= least)
        keep = keep & (F.col(topics) <= most) if most is not None else keep
    return grid.filter(keep)


def with_combined(grid: DataFrame, first: str, second: str, weight: float = 0.5) -> DataFrame:
    """combined: the weighted sum of both scores scaled to [0, 1]; a constant score scales to 0.5.

    The limits are one small aggregate, joined to every row."""
    limits = grid.agg(*[f(c).alias(f"_{n}_{c}") for c in (first, second) for f, n in ((F.min, "low"), (F.max, "high"))])
    scaled = lambda c: F.when(F.col(f"_high_{c}") > F.col(f"_low_{c}"), (F.col(c) - F.col(f"_low_{c}")) / F.nullif(F.col(f"_high_{c}") - F.col(f"_low_{c}"), F.lit(0.0))).otherwise(0.5)
    out = grid.crossJoin(F.broadcast(limits))  # one row
    return out.withColumn("combined", weight * scaled(first) + (1 - weight) * scaled(second)).select(*grid.columns, "combined")


def pareto(grid: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that no other row equals or exceeds in both scores and exceeds in one.

    Per value of the first score its best second score; a row is dominated by a better second score at an
    equal first one, or by an equal or better second score at any larger first one: a running maximum."""
    best = grid.groupBy(first).agg(F.max(second).alias("_best"))
    above = Window.orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, -1)
    limit = best.withColumn("_above", F.max("_best").over(above))
    joined = grid.join(limit, first)
    return joined.filter((F.col(second) >= F.col("_best")) & (F.col("_above").isNull() | (F.col(second) > F.col("_above")))).select(*grid.columns)
