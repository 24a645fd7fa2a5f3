"""Experiment matrices, checkpoints and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def axes(spark: SparkSession, **values) -> DataFrame:
    """Every combination of the axes' values, which are configuration: one exploded row, no join."""
    out = spark.range(1).drop("id")
    for name, own in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in own])).alias(name))
    return out


#: The models, methods and variants of the three settings.
MODELS = ("qwen", "llama", "granite")
METHODS = ("ga", "npo", "prod")
BATCH_ORDERS = ("interleaved", "forget_first")
RETAINS = ("half", "full")


def job_matrix(spark: SparkSession, models=MODELS, methods=METHODS, orders=BATCH_ORDERS, retains=RETAINS) -> DataFrame:
    """The jobs of three settings: orders, retain sizes, and both crossed."""
    blank = F.lit("")
    first = axes(spark, model=models, method=methods, batch_order=orders).select(F.lit("rq1").alias("setting"), "*", blank.alias("retain"))
    second = axes(spark, model=models, method=methods, retain=retains).select(F.lit("rq2").alias("setting"), "model", "method", blank.alias("batch_order"), "retain")
    third = axes(spark, model=models, method=methods, batch_order=orders, retain=retains).select(F.lit("rq3").alias("setting"), "*")
    jobs = first.unionByName(second).unionByName(third)
    return jobs.withColumn("job", F.concat_ws("|", "model", "method", "batch_order", "retain"))


def decode_job(job: Column) -> Column:
    parts = F.split(job, r"\|", -1)
    return F.struct(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("model", "method", "batch_order", "retain", "suffix"))])


def checkpoints(paths: DataFrame, path: str = "path") -> DataFrame:
    """(adapter, checkpoint): distinct checkpoint-<n> folders among object paths."""
    found = paths.select("adapter", F.regexp_extract(path, r"^(checkpoint-\d+)(?:/|$)", 1).alias("checkpoint"))
    return found.filter("checkpoint <> ''").distinct()


def natural_order(name: Column) -> list[Column]:
    """Numbered checkpoints by number, then other names."""
    number = F.regexp_extract(name, r"^checkpoint-(\d+)$", 1)
    return [F.when(number != "", 0).otherwise(1), F.nullif(number, F.lit("")).cast("long"), name]


def choose(found: DataFrame, first: int | None = None, last: int | None = None, index: int | None = None) -> DataFrame:
    """All checkpoints of each adapter, or the first or last some, or that with a number from 1.

    An adapter that has fewer than are asked for, or none with the number, is an error."""
    if sum(x is not None for x in (first, last, index)) > 1:
        raise ValueError("first, last and index exclude each other")
    wanted = next((x for x in (first, last, index) if x is not None), 0)
    if wanted < 0 or (wanted == 0 and index is not None):
        raise ValueError(f"{wanted} is not counted from 1")
    short = found.groupBy("adapter").count().filter(F.col("count") < wanted).orderBy("adapter").limit(3).collect() if wanted else []
    if short:
        raise ValueError(f"fewer than {wanted} checkpoints: {[(r['adapter'], r['count']) for r in short]}")
    own = Window.partitionBy("adapter")
    at = F.row_number().over(own.orderBy(*natural_order(F.col("checkpoint"))))
    out = found.withColumn("at", at).withColumn("n", F.count("*").over(own))
    if index is not None:
        out = out.filter(F.col("at") == index)
    elif first is not None:
        out = out.filter(F.col("at") <= first)
    elif last is not None:
        out = out.filter(F.col("at") > F.col("n") - last)
    return out.drop("at", "n")


def with_alias(chosen: DataFrame, start: int = 1) -> DataFrame:
    """epoch-<i> for each chosen checkpoint, counted from start within its adapter."""
    at = F.row_number().over(Window.partitionBy("adapter").orderBy(*natural_order(F.col("checkpoint"))))
    return chosen.withColumn("alias", F.concat(F.lit("epoch-"), (at + start - 1).cast("string")))


def evaluation_configs(chosen: DataFrame, pass_k: int, splits=("forget", "retain", "approximate")) -> DataFrame:
    """A row for each checkpoint and split; attempts are sampled if there are several."""
    out = chosen.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    return out.withColumn("do_sample", F.lit(pass_k > 1)).withColumn("attempts", F.lit(pass_k))


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(adapter, alias, checkpoint): new entries override old ones."""
    both = old.withColumn("v", F.lit(0)).unionByName(new.withColumn("v", F.lit(1)))
    return both.groupBy("adapter", "alias").agg(F.max_by("checkpoint", "v").alias("checkpoint"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimator 1 - C(n-c, k) / C(n, k), as a product."""
    factors = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (n - c - i).cast("double") / F.greatest(n - i, F.lit(1)))
    miss = F.aggregate(factors, F.lit(1.0), lambda p, x: p * x)
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(1.0 - miss)


def reporting_points(k: int) -> list[int]:
    return sorted({1, -(-k // 2), k})


def exclude(results: DataFrame, excluded: DataFrame, *keys: str) -> DataFrame:
    """Results without the excluded keys; the raw table stays as it is."""
    return results.join(excluded.select(*keys).distinct(), list(keys), "left_anti")
