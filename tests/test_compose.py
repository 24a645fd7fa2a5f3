import math
from collections import Counter

from pyspark.sql import functions as F

from quillon.functions.text_scores import chrf, forget_quality
from quillon.operators import compose


def test_composition_counts_shared_keys(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(2,), (3,)], "k long")
    rows = {r.role: (r.n_rows, r.n_keys, r.n_shared) for r in compose.composition({"a": a, "b": b, "none": a.limit(0)}, "k").collect()}
    assert rows == {"a": (4, 2, 1), "b": (2, 2, 1)}


def test_balance_override_and_uuid(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "x", "p"), (4, None, None)], "id long, g string, v string")
    assert {r.g: (r.n, r.n_p, r.n_q, r.spread) for r in compose.balance(df, "g", "v", ("p", "q")).collect()} == {"x": (3, 2, 1, 1), None: (1, 0, 0, 0)}
    new = spark.createDataFrame([(2, "new"), (3, None), (9, "z")], "id long, v string")
    assert {r.id: r.v for r in compose.override(df, new, "id", "v").collect()} == {1: "p", 2: "new", 3: "p", 4: None}
    assert compose.with_uuid(df).select("uuid").distinct().count() == 4


def test_yaml_quotes_strings(spark):
    df = spark.createDataFrame([(1, 'a "b"\nc', ["x", "y"], None)], "n int, s string, l array<string>, m string")
    assert df.select(compose.yaml_of(df)).first()[0] == 'n: 1\ns: "a \\"b\\"\\nc"\nl: ["x","y"]\nm: null'


def brute_chrf(r, p):
    r, p = r.replace(" ", ""), p.replace(" ", "")
    found = []
    for n in range(1, 7):
        a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (r, p))
        if a or b:
            hit = sum(min(c, b[g]) for g, c in a.items())
            found.append((hit / max(1, sum(b.values())), hit / max(1, sum(a.values()))))
    x, y = (sum(f[k] for f in found) / len(found) for k in (0, 1))
    return 5 * x * y / (4 * x + y) if x + y else 0.0


def test_forget_quality(spark):
    for r, p in (("the cat sat", "the cat sat"), ("abcdef", "xyz"), ("the cat sat on", "a cat sat"), ("a", "abc")):
        assert math.isclose(chrf(r, p), brute_chrf(r, p), abs_tol=1e-12)
    rows = [("a b c d", "a b c d"), ("a b", "x y"), (None, ""), ("a", None)]
    df = spark.createDataFrame(rows, "r string, p string").select(forget_quality("r", "p").alias("q")).select("q.*")
    assert [tuple(r) for r in df.collect()] == [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0), (1.0, 1.0)]
    assert df.filter(F.col("secret").isNull()).count() == 0
