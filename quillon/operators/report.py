"""What audits and evaluation runs report: ranges of rows, pairs above thresholds, ordered counts, failures, trade-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import checkpointed

#: Difficulty buckets in the order of the report.
BUCKETS = ("simple", "moderate", "complex", "out-of-range", "error")
#: Columns of a row's summary.
SUMMARY = ("row_id", "id", "task_id", "source", "type", "difficulty", "entry_point", "title")
#: The most ids of survivors that a report lists.
LISTED_SURVIVORS = 50
EPOCHS = (4, 8, 12)


def with_row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """df with the number of each row from 0, in the order of the columns; rows equal in these have any order among them.

    Rows are sorted by ranges; each range's count moves the next ranges' numbers, so no task holds all rows. The driver
    gets one count for each range."""
    parted = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in parted.groupBy(part.alias("p")).count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return parted.withColumn(name, F.lit(0).cast("long")).drop("_at")
    moved = F.create_map(*[x for p, n in before.items() for x in (F.lit(p).cast("long"), F.lit(n).cast("long"))])
    return parted.withColumn(name, place + moved[part]).drop("_at")


def row_range(indexed: DataFrame, start: int = 0, end: int | None = None, index: str = "row_index") -> DataFrame:
    """Rows start to end (exclusive; None: to the last) of rows with an index; a limit is a range from 0."""
    if start < 0 or (end is not None and end < start):
        raise ValueError(f"no range from {start} to {end}")
    rows = indexed.filter(F.col(index) >= start)
    return rows if end is None else rows.filter(F.col(index) < end)


def row_summary(df: DataFrame, columns=SUMMARY) -> DataFrame:
    """The summary's columns; those that df lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def task_id(df: DataFrame, index: str) -> Column:
    """The column task_id, else id, else <row n>; a null in the column that there is stays null."""
    found = [c for c in ("task_id", "id") if c in df.columns]
    return F.col(found[0]).cast("string") if found else F.format_string("<row %d>", F.col(index))


def above(first: Column, least: float, second: Column | None = None, second_least: float | None = None) -> Column:
    """first reaches least, or second reaches its own threshold, if it has one."""
    found = F.coalesce(first >= least, F.lit(False))
    return found if second is None or second_least is None else found | F.coalesce(second >= second_least, F.lit(False))


def ranked_pairs(pairs: DataFrame, score: str) -> DataFrame:
    """Pairs by falling score, equal ones by (i, j)."""
    return pairs.orderBy(F.desc(score), "i", "j")


def write_pairs(pairs: DataFrame, keep: Column, path: str) -> None:
    """The pairs to keep as JSON lines, nulls written."""
    pairs.filter(keep).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def pair_counts(n: Column) -> Column:
    """Unordered pairs of n rows, and ordered ones."""
    whole = n.cast("long")
    return F.struct((whole * (whole - 1) / 2).cast("long").alias("pairs"), (whole * (whole - 1)).alias("directed"))


def ordered_counts(df: DataFrame, column: str, order=BUCKETS) -> DataFrame:
    """(at, value, n) of the order's values that occur, in its order; others and nulls are left out."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("at", at.cast("int")).filter("at > 0").select("at", F.col(column).alias("value"), "n")


def mismatches(df: DataFrame, ok: str = "ok") -> DataFrame:
    """Rows that are not ok; a row that lacks the answer, because it failed, counts as one."""
    return df.filter(~F.coalesce(F.col(ok), F.lit(False)))


def survivors(df: DataFrame, ids: str = "survived_ids", most: int = LISTED_SURVIVORS) -> DataFrame:
    """Rows with survivors, with the first ids of these; the count stays whole."""
    return df.filter(F.col("survived") > 0).withColumn(ids, F.slice(F.col(ids), 1, most))


def failures(df: DataFrame, job: str = "job", status: str = "exit_code") -> DataFrame:
    """One row: how many jobs, how many failed (a status that is not 0 or is missing), their sorted names, and the exit code of the whole."""
    bad = F.coalesce(F.col(status) != 0, F.lit(True))
    names = F.sort_array(F.collect_list(F.when(bad, F.col(job)))).alias("failed_jobs")
    return df.agg(F.count("*").alias("jobs"), F.count_if(bad).alias("failed"), names, F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("exit_code"))


def trade_offs(facts: DataFrame, metrics, baseline: str = "base") -> DataFrame:
    """(model, method, variant, epoch) with a column for each metric (the mean of its values) and its change from the model's baseline method."""
    wide = facts.groupBy("model", "method", "variant", "epoch").pivot("metric", list(metrics)).agg(F.avg("value"))
    base = facts.filter(F.col("method") == baseline).groupBy("model").pivot("metric", list(metrics)).agg(F.avg("value"))
    base = base.select("model", *[F.col(m).alias(f"base_{m}") for m in metrics])
    out = wide.filter(F.col("method") != baseline).join(base, "model", "left")
    return out.select("model", "method", "variant", "epoch", *[F.round(m, 6).alias(m) for m in metrics], *[F.round(F.col(m) - F.col(f"base_{m}"), 6).alias(f"{m}_change") for m in metrics])


def chosen_checkpoints(spark: SparkSession, explicit: list[str], found: DataFrame, discover: bool, epochs=EPOCHS) -> DataFrame:
    """(adapter, checkpoint): explicit names for every adapter go first; without them and unless discovery is asked for, those of
    the default epochs; else what was found."""
    adapters = found.select("adapter").distinct()
    names = explicit or ([] if discover else [f"epoch-{e}" for e in epochs])
    return adapters.withColumn("checkpoint", F.explode(F.array(*[F.lit(n) for n in names]))) if names else found.select("adapter", "checkpoint")


def setting_columns(setting: Column) -> Column:
    """The names of a setting's prefix, suffix and target columns: secrets have their own."""
    secret = F.struct(F.lit("secret_prefix").alias("prefix"), F.lit("secret_suffix").alias("suffix"), F.lit("secret").alias("target"))
    code = F.struct(F.lit("prefix").alias("prefix"), F.lit("suffix").alias("suffix"), F.lit("code").alias("target"))
    return F.when(setting == "secret", secret).otherwise(code)


def result_path(root: str, model: Column, method: Column, variant: Column, checkpoint: Column, split: Column) -> Column:
    """Where a run's results go: one folder for each value, slashes in names written as two underscores; a blank variant has none."""
    safe = lambda c: F.replace(c, F.lit("/"), F.lit("__"))
    return F.concat_ws("/", F.lit(root.rstrip("/")), safe(model), safe(method), F.when(variant != "", safe(variant)), safe(checkpoint), F.concat(safe(split), F.lit(".jsonl")))


def unit_rows(vector: Column) -> Column:
    """The vector by its length, or by 1e-12 where that is larger."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.greatest(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(wide, lambda x: x / length)


def topic_info(assigned: DataFrame, terms: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, n, terms): how many rows each topic has and its terms by rank; the noise topic -1 has none."""
    counts = assigned.groupBy(topic).agg(F.count("*").alias("n"))
    named = terms.filter(F.col(topic).cast("string") != "-1").groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return counts.join(named, topic, "left").select(topic, "n", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
