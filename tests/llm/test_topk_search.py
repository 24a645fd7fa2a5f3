import math
import random

from pyspark.sql import functions as F

from quillon.llm import topk_search as t


def brute(rows, every, k=5):
    items = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        items.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = set()
    for q in items:
        if q % every:
            continue
        best = {}
        for c in items:
            if c != q:
                s = [sum(a * b for a, b in zip(x, y, strict=True)) for x in items[q] for y in items[c] if len(x) == len(y)]
                if s:
                    best[c] = min(max(max(s), -(2**63)), 2**63 - 1)
        for rank, c in enumerate(sorted(best, key=lambda c: (-best[c], c))[:k], 1):
            out.add((q, rank, c, best[c]))
    return out


def run(spark, rows, every, **more):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return {tuple(r) for r in t.search(df, F.col("vec_id") % every == 0, **more).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]  # copies tie
    rng.shuffle(rows)
    assert run(spark, rows, 7, shard_rows=100, leaf=8) == brute(rows, 7)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [2.0**40, -(2.0**40)]), (5, []), (10, []), (None, [1.0, 1.0]), (6, [1.0]), (10, [-2.0, 5.0]), (-5, [0.0, 0.0]), (11, [0.5, 0.5]), (12, [0.5, 0.5])]
    assert run(spark, rows, 5) == brute(rows, 5)
    assert run(spark, [], 5) == set()
    assert run(spark, rows[:1], 5) == set()
