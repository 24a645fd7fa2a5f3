"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is built from DataFrame functions over the whole text, so the rules run inside the JVM
in the scan's own stage: no shuffle, no user function, no state besides the row.

Defined results: a null, empty or blank text has no words, all its counts are 0 and it fails the base
(n_words < 10); equal rows give equal rows; an empty table gives an empty table; other columns of the
input, whatever their names, are left out by `measure` and kept by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, WORD, bind

#: Common function words of the supported languages.
STOP_WORDS = (
    "the of and to in is that it for on was with as be by at from this are or a an "
    "de la le les des et en un une du que est pour pas dans sur qui au par "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine "
    "el los las y del se por con para una su al lo como mi"
).split()

#: The threshold table: name, measure, the least and the most value that passes (None: open).
#: Ratios of a text without words or lines are 0; stop_ratio counts one stop word more than there are,
#: so that a short text is not judged by the absence of a few words.
THRESHOLDS = (
    ("mean_word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("exclamations", "exclamation_ratio", None, 0.3),
    ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.4),
    ("repeated_neighbours", "neighbour_ratio", None, 0.3),
)

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def _ratio(above: Column, below: Column) -> Column:
    return F.when(below > 0, above / below).otherwise(F.lit(0.0))


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the text.

    Windows are compared by one 64-bit hash of their words' hashes. Only a text in which some
    hash repeats sorts its windows, so the cost is linear for clean texts and n log n for others.
    """
    width = WINDOW

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - F.lit(width))
        windows = F.transform(starts, lambda i: F.xxhash64(*[h[i + F.lit(k)] for k in range(width)]))

        def of_windows(g: Column) -> Column:
            def of_sorted(s: Column) -> Column:
                last = F.size(s) - F.lit(1)
                twin = F.transform(
                    s,
                    lambda x, i: F.when(
                        ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["g"] == x["g"])) | ((i < last) & (s[F.least(i + 1, last)]["g"] == x["g"])),
                        x["i"],
                    ),
                )
                at = F.sort_array(F.filter(twin, lambda p: p.isNotNull()))
                return bind(
                    at,
                    lambda a: F.aggregate(
                        F.zip_with(a, F.slice(a, 2, F.size(a)), lambda p, q: F.coalesce(F.least(q - p, F.lit(width)), F.lit(width))),
                        F.lit(0).cast("long"),
                        lambda total, step: total + step,
                    ),
                )

            pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(bind(pairs, of_sorted))

        return bind(windows, of_windows)

    return F.when(F.size(words) < width + 1, F.lit(0).cast("long")).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, the contract's counts and the ratios that the threshold table names, for every row of docs.

    Measures: words are runs of characters outside \\x20 and \\x09-\\x0D; word_chars counts code points
    in words; n_symbols counts #*$%&|<>; n_dup_lines counts \\n-split lines with a word that equal an
    earlier line; n_repeat_words counts words in 5-word windows found twice or more.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias("doc_id"),
        F.regexp_extract_all(whole, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(whole, r"[^!]+", "")).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace(whole, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        bind(
            F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD)),
            lambda lines: F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")),
        ).alias("lines"),
    )
    # the counts read `words` as a bound value, so that the split is made once for a row
    counted = base.select(
        "doc_id",
        bind(
            F.col("words"),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(w, lambda x, i: (i > 0) & (x == w[F.greatest(i - 1, F.lit(0))]))).cast("long").alias("n_neighbours"),
            ),
        ).alias("c"),
        "n_symbols",
        "n_exclamations",
        "word_chars",
        "lines",
    )
    n_words = F.col("c.n_words")
    return counted.select(
        "doc_id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.n_dup_lines").alias("n_dup_lines"),
        F.col("c.n_repeat_words").alias("n_repeat_words"),
        _ratio(F.col("word_chars"), n_words).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n_words).alias("symbol_ratio"),
        _ratio(F.col("n_exclamations"), n_words).alias("exclamation_ratio"),
        _ratio(F.col("c.n_stop_words") + 1, n_words).alias("stop_ratio"),
        _ratio(F.col("lines.n_dup_lines"), F.col("lines.n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("c.n_neighbours"), n_words).alias("neighbour_ratio"),
    )


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """One boolean expression that holds where every row of the threshold table is met."""
    verdict = F.lit(True)
    for _, name, least, most in thresholds:
        if least is not None:
            verdict = verdict & (F.col(name) >= F.lit(least))
        if most is not None:
            verdict = verdict & (F.col(name) <= F.lit(most))
    return verdict


def judge(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, counts, base_failed and kept for every row of docs, then the ratios."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = measure(docs, text, key)
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & compile_rules(thresholds)).alias("kept"),
        *[name for _, name, _, _ in thresholds],
    )


def keep_good(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose text passes, with their own columns: a filter within the scan's stage."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    names = docs.columns
    judged = judge(packed.select(F.col("row").alias("doc_id"), "text"), thresholds, "text", "doc_id")
    return judged.filter("kept").select(*[F.col("doc_id")[name].alias(name) for name in names])


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = " AND ".join(
        [f"{name} >= {least}" for _, name, least, _ in THRESHOLDS if least is not None] + [f"{name} <= {most}" for _, name, _, most in THRESHOLDS if most is not None]
    )
    ratio = lambda a, b, name: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END AS {name}"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) AS grams FROM w),
p AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
s AS (SELECT doc_id, sum(least(5, coalesce(lead_i - i, 5)))::BIGINT AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1]))::BIGINT AS n_neighbours,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN s USING (doc_id)),
x AS (SELECT *, {ratio('word_chars', 'n_words', 'mean_word_chars')}, {ratio('n_symbols', 'n_words', 'symbol_ratio')},
             {ratio('n_exclamations', 'n_words', 'exclamation_ratio')}, {ratio('(n_stop_words + 1)', 'n_words', 'stop_ratio')},
             {ratio('n_dup_lines', 'n_lines', 'dup_line_ratio')},
             {ratio('n_neighbours', 'n_words', 'neighbour_ratio')},
             (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {tests}) AS kept, mean_word_chars, symbol_ratio, exclamation_ratio, stop_ratio, dup_line_ratio, neighbour_ratio
FROM x"""


SQL = _sql()
