import random

import numpy as np

from quillon.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def brute(w):
    """Maximal segments by the recursive definition: the best segment, then those left and right of it."""
    n = len(w)
    sums = np.concatenate([[0], np.cumsum(w)])
    best = max(((sums[j] - sums[i], i, j) for i in range(n) for j in range(i + 1, n + 1)), key=lambda x: (x[0], -x[1], -x[2]), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, i, j = best
    return brute(w[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(w[j:])]


def test_segments_match_definition():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.choice([-1, 1]) * rng.randint(1, 10**6) for _ in range(rng.randint(0, 25))]
        assert [(s, e) for s, e, _ in t.maximal_segments(w)] == brute(w)


def test_short_form_finds_the_same_segments():
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(8)]
    model = t.SegmentModel({w: rng.uniform(-2, 2) for w in words[:5]})
    for _ in range(100):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        whole = t.maximal_segments([model.weights.get(w, -t.DRIFT) for w in text])
        got = model.segments(" ".join(text))[0]
        assert [x[:2] for x in got] == [x[:2] for x in whole]
        assert np.allclose([x[2] for x in got], [x[2] for x in whole])


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    out = t.judge(docs, labels)
    assert out.count() == docs.count()
    held = [r for r in out.join(labels, "doc_id").collect() if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit >= 0.7 * sum(r.toxic for r in held)
    assert sum(r.predicted and not r.toxic for r in held) <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", 0.1), (1, "you idiot", 0.1), (2, None, 0.2), (None, "", 0.3), (3, "fine " * 20000, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert t.judge(docs, labels).count() == 5
    assert {r.score for r in t.judge(docs, labels.limit(0)).collect()} == {0.0}
    assert t.judge(docs.limit(0), labels).count() == 0


def test_significant_passages_are_returned(spark):
    model = t.SegmentModel({"vile": 3.0, "foul": 3.0}, lam=1.0, k=1.0, curve=(-1.0, 0.1, 1.0), scale=1.0)
    rows = [(1, "a b vile foul c d e"), (2, "nothing here"), (3, None)]
    out = {r.doc_id: r.passages for r in t.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(p.start, p.end) for p in out[1]] == [(2, 4)] and out[1][0].s > t.SIGNIFICANT and out[2] == out[3] == []
