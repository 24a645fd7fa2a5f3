"""Test-hardening reports: logs of mutation runs, equivalence of mutants, pooled scores, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a progress line, and what they count.
MARKS = {"killed": "🎉", "survived": "🙁", "timeout": "⏰", "suspicious": "🤔", "no_coverage": "🫥"}
STATUSES = ("killed", "survived", "timeout", "suspicious")


#: The formats of the tool's progress lines, headed counts and lines of ids are those that the patterns below read.


def _number(text: Column, pattern: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int"), F.lit(0))


def progress_counts(log: Column) -> Column:
    """Counts of the last progress line of a run; all 0 without one."""
    last = F.coalesce(F.try_element_at(F.filter(F.split(log, "\n"), lambda l: l.rlike(f"[0-9]+/[0-9]+.*{MARKS['killed']}")), F.lit(-1)), F.lit(""))
    return F.struct(*[_number(last, rf"{mark}\s*([0-9]+)").alias(name) for name, mark in MARKS.items()], _number(last, r"[0-9]+/([0-9]+)").alias("total"))


def result_counts(text: Column) -> Column:
    """Counts of a results text with one headed status after the other; the total is their sum."""
    found = [_number(text, rf"(?im)^{s}[^\n(]*\(([0-9]+)\)") for s in STATUSES]
    total = found[0]
    for f in found[1:]:
        total = total + f
    return F.struct(*[f.alias(s) for s, f in zip(STATUSES, found, strict=True)], total.alias("total"))


def mutants(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mutant, status) of every line `<id>: <status>` of a results text."""
    line = df.select(key, F.explode(F.split(text, "\n")).alias("line"))
    parts = line.select(key, F.regexp_extract("line", r"^\s*(\S*__mutmut_[0-9]+):\s*[a-z][a-z ]*?\s*$", 1).alias("mutant"), F.regexp_extract("line", r":\s*([a-z][a-z ]*?)\s*$", 1).alias("status"))
    return parts.filter("mutant <> ''")


def ids_for(text: Column, status: str) -> Column:
    """Mutants of a status (Survived, No coverage): by lines of ids, else by a block of places, else by numbers."""
    wanted = {"no coverage": ("no tests", "no coverage")}.get(status.lower(), (status.lower(),))
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(r"^\s*\S*__mutmut_[0-9]+:\s*[a-z][a-z ]*?\s*$"))
    of = lambda s: F.transform(F.filter(lines, lambda l: l.rlike(rf":\s*{s}\s*$")), lambda l: F.regexp_extract(l, r"^\s*(\S*__mutmut_[0-9]+):", 1))
    by_line = F.lit(None).cast("array<string>")
    for s in reversed(wanted):
        by_line = F.when(F.size(of(s)) > 0, of(s)).otherwise(by_line)
    block = F.regexp_extract(text, rf"(?ms)^{status}[^\n]*:\s*\n(.*?)(?=^\S|\Z)", 1)
    places = F.regexp_extract_all(block, F.lit(r"([\w./]+:[0-9]+)"), F.lit(1))
    older = F.regexp_extract(text, rf"(?ims)^{status}[^\n]*\n(.*?)(?=^(?:Killed|Survived|Timeout|Suspicious|No coverage|To apply)|\Z)", 1)
    return F.when(F.size(lines) > 0, F.coalesce(by_line, F.array().cast("array<string>"))).when(F.size(places) > 0, places).otherwise(F.regexp_extract_all(older, F.lit("([0-9]+)"), F.lit(1)))


def likely_equivalent(diff: Column) -> Column:
    """Whether a mutant's changed lines only assign string literals, or only say pass."""
    changed = F.filter(F.split(diff, "\n"), lambda l: (l.startswith("+") | l.startswith("-")) & ~l.startswith("+++") & ~l.startswith("---"))
    body = F.transform(changed, lambda l: F.substring(l, 2, 1_000_000))
    literal = F.forall(body, lambda l: l.rlike(r"""^\s*\w+\s*=\s*(".*"|'.*')\s*$"""))
    empty = F.forall(body, lambda l: F.trim(l) == "pass")
    return (F.size(body) > 0) & (literal | empty)


def pooled(rows: DataFrame) -> DataFrame:
    """The score of all rows without error: killed mutants by all mutants, not a mean of scores."""
    ok = F.col("error").isNull()
    killed, total = (F.sum(F.when(ok, F.col(c))) for c in ("killed", "total_mutants"))
    return rows.agg(F.coalesce(F.round(100 * F.try_divide(killed.cast("double"), total), 6), F.lit(0.0)).alias("score"), F.sum("survived").alias("survived_total"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for every idx of either run: scores, their difference, and the difference in survivors."""
    b, a = (df.select("idx", *[F.col(c).alias(f"{c}_{s}") for c in ("function_name", "mutation_score_pct", "survived", "killed", "total_mutants")]) for df, s in ((before, "before"), (after, "after")))
    return b.join(a, "idx", "full_outer").select(
        "idx", F.coalesce("function_name_after", "function_name_before", F.lit("?")).alias("function_name"), "mutation_score_pct_before", "mutation_score_pct_after",
        F.round(F.col("mutation_score_pct_after") - F.col("mutation_score_pct_before"), 6).alias("delta_pp"), (F.col("survived_after") - F.col("survived_before")).alias("delta_survived"),
        "killed_before", "killed_after", "total_mutants_before", "total_mutants_after",
    )


def pooled_change(compared: DataFrame) -> DataFrame:
    """Pooled scores of both sides; a side with no mutants in a row adds nothing."""
    score = lambda s: F.round(100 * F.try_divide(F.sum(F.when(F.col(f"total_mutants_{s}") > 0, F.col(f"killed_{s}"))).cast("double"), F.sum(f"total_mutants_{s}")), 6)
    return compared.agg(score("before").alias("score_before"), score("after").alias("score_after"), F.sum("delta_survived").alias("delta_survived"))
