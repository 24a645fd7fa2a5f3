import tracemalloc
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np

from quillon.llm import lm_score as lm

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b"<end>"]


def brute(rows, masses):
    c, docs = [Counter() for _ in range(len(masses) + 2)], 0
    for d, t in rows:
        if zlib.crc32((str(d) if d is not None else "").encode()) % 10:
            ts = [b"<start>", *tokens(t)]
            for k in range(1, len(masses) + 2):
                c[k].update(tuple(ts[i : i + k]) for i in range(len(ts) - k + 1))
            docs += 1
    n, v = sum(x for w, x in c[1].items() if w != (b"<start>",)), len(c[1].keys() - {(b"<start>",)})
    single = lambda w: ((c[1][(w,)] if w != b"<start>" else 0) + 0.1) / (n + 0.1 * (v + 1))

    def p(w, h):
        if not h:
            return single(w)
        mass = masses[len(h) - 1]
        return (c[len(h) + 1][(*h, w)] + mass * p(w, h[1:])) / (c[len(h)][h] + mass)

    out = []
    for d, t in rows:
        ts = tokens(t)
        whole = [b"<start>", *ts]
        base = sum(log10(single(w)) for w in ts)
        score = sum(log10(p(w, tuple(whole[max(0, i + 1 - len(masses)) : i + 1]))) for i, w in enumerate(ts))
        out.append((d, zlib.crc32((str(d) if d is not None else "").encode()) % 10 == 0, len(ts), sum(c[1][(w,)] > 0 for w in ts), n, base, score))
    return out


def same(spark, rows, masses=lm.MASSES, **more):
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, lm.score(df, masses, **more).collect()), key=key), sorted(brute(rows, masses), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)
    return got


def test_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = same(spark, rows)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # contexts help on texts that taught nothing


def test_edges(spark):
    same(spark, [(1, None), (2, ""), (2, ""), (None, "É é A a\x0b\x0c b"), (3, "a b " * 30000), (4, "a b a c")], (2.0,))
    same(spark, [(10, "x y")])
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    same(spark, [(held, "only held out"), (held, None)])
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_orders_and_shards(spark):
    rows = [(i, " ".join("abcd"[(i * k * k + k // 3) % 4] for k in range(i % 23))) for i in range(120)]
    for masses in ((3.0,), (3.0, 2.0), (5.0, 2.0, 1.0, 0.5)):
        same(spark, rows, masses, shard_bytes=60)
    names = lm.score(spark.createDataFrame([("x", "a b"), (None, "a"), ("x", "a b")], "doc_id string, text string"))
    assert sorted(str(r.doc_id) for r in names.collect()) == ["None", "x", "x"]


def test_weights_after_every_state_sum_to_one():
    import numpy as np

    taught = ["a b a c", "b b a", "c a b", None]
    for history in ("", "a", "a b", "b b", "c c", "new a", "a new"):
        words = ["a", "b", "c", "unseen", None]
        texts = [f"{history} {w}" if w else history for w in words]
        docs = lm.Documents.of(taught + texts)
        grams = lm.Grams(docs, 3)
        counts = grams.counts(np.arange(len(docs.lengths)) < len(taught))
        auto = lm.Automaton(grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), (3.0, 2.0))
        weights, after = auto.weights, auto.after
        ends = np.cumsum(docs.lengths)[len(taught) :] - 1
        at = [e if w is None else e - 1 for e, w in zip(ends, words, strict=True)]
        states = [1 if not history else int(after[i - 1]) for i in at]
        assert len(set(states)) == 1  # one history, one state
        assert isclose(sum(10 ** weights[states[0], i] for i in at), 1.0)


def test_a_repeated_training_text_scores_apart(spark):
    held_out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    text = lambda i, a, b: " ".join(f"w{(i * a + k * k * b) % 997}" for k in range(60))
    rows = [(i, text(i, 7919, 31)) for i in range(1, 200)]
    taught = [t for i, t in rows if not held_out(i)]
    copies = list(zip([i for i in range(1000, 1200) if held_out(i)], taught, strict=False))
    fresh = [(i, text(i, 104729, 57)) for i in range(5000, 5200) if held_out(i)]
    found = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows + copies + fresh, "doc_id long, text string")).collect()}
    assert len(copies) > 10 and min(found[i] for i, _ in copies) > max(found[i] for i, _ in fresh) + 0.3


def test_memory_of_a_shard_per_token():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 2000) % 50_000) for _ in range(100)]
    docs = lm.Documents.of(texts)
    n = len(docs.tokens)
    tracemalloc.start()
    grams = lm.Grams(docs)
    counts = grams.counts(np.ones(len(texts), dtype=bool))
    tracemalloc.reset_peak()
    start = tracemalloc.get_traced_memory()[0]
    lm.Automaton(grams, counts, n, len(grams.keys[0]))
    used = tracemalloc.get_traced_memory()[1] - start
    tracemalloc.stop()
    assert docs.tokens.nbytes + used < 74 * n, (docs.tokens.nbytes + used) / n


def test_runs_of_documents_score_as_the_shard_does():
    rng = np.random.default_rng(5)
    texts = [None, "", *[" ".join(f"w{x}" for x in rng.zipf(1.4, int(n)) % 500) for n in rng.integers(0, 60, 80)]]
    grams = lm.Grams(lm.Documents.of(texts))
    counts = grams.counts(np.arange(len(texts)) % 3 > 0)
    total, distinct = int(counts[0].sum()), int((counts[0] > 0).sum())
    whole = lm.Automaton(grams, counts, total, distinct).traverse()
    for tokens in (1, 50, 10**6):
        runs = list(grams.runs(tokens))
        assert len(runs) > 1 or tokens == 10**6
        assert np.array_equal(np.concatenate([lm.Automaton(r, counts, total, distinct).traverse() for r in runs]), whole)
    keys, number = lm._numbered(np.array([7, 3, 7, 9, 3], dtype=np.uint64))
    assert keys.tolist() == [3, 7, 9] and number.tolist() == [1, 0, 1, 2, 0]
    assert [len(x) for x in lm._numbered(np.zeros(0, dtype=np.uint64))] == [0, 0]
