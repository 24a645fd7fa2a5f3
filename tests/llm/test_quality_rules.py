import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def got(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = q.judge(df).orderBy("doc_id").collect()
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows], rows


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t|é😀", max_size=120)), min_size=1, max_size=20))
def test_counts_match_brute_force(spark, texts):
    assert got(spark, texts)[0] == [brute(t) for t in texts]


def test_edges(spark):
    long = "a b c d e f " * 4000
    texts = [None, "", " \n\t", "one two", long, "the " * 3 + " ".join(f"w{i}" for i in range(30))]
    counts, rows = got(spark, texts)
    assert counts == [brute(t) for t in texts]
    assert [r.base_failed for r in rows] == [True, True, True, True, True, False]
    assert rows[-1].kept


def test_keep_good_keeps_clashing_columns(spark):
    good = "the house of the man and the tree in a garden is near to it"
    df = spark.createDataFrame([(1, good, 5, True), (1, good, 5, True), (2, "x", 6, False)], "doc_id long, text string, n_words long, kept boolean")
    out = q.keep_good(df)
    assert out.columns == df.columns and out.count() == 2
    assert q.keep_good(df.filter(F.lit(False))).count() == 0
