import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash_dedup as s


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    label = {i: i for i in ids}
    while True:
        changed = False
        for i in ids:
            for j in ids:
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
        if not changed:
            return label


def test_fingerprint_is_sparks_hash(spark):
    texts = [None, "", " \n", "One", "one TWO", "a b c", "É a B c\td\x0be f g", "x y z " * 5000]
    assert [s.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == int(np.uint64(s.fingerprint("a b c")).view(np.int64))


def cloud(n, seed, centre=None):
    rng = random.Random(seed)
    out = {}
    points = [rng.getrandbits(64)] if centre is None else [centre]
    for i in range(n):
        p = rng.choice(points)
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        points.append(p if rng.random() < 0.8 else rng.getrandbits(64))
        out[i * 3 + 1] = points[-1]
    return out


def run(spark, fps, crowded):
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in fps.items()], "doc_id long, fp long")
    return {r.doc_id: r.component_id for r in s.components_of(df, crowded=crowded).collect()}


def test_components_match_brute_force(spark):
    fps = cloud(150, 1)
    want = brute_components(fps)
    assert run(spark, fps, 512) == want
    assert run(spark, fps, 2) == want  # crowded segments are told apart by the other one


def test_find_and_drop(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (9, "A b  c d", 2), (None, "a b c d", 3), (2, None, 4), (3, "", 5), (4, "other words entirely here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = s.find(df)
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"] and out.count() == 7
    got = {(r.doc_id, r.component_id) for r in out.collect()}
    assert got == {(5, 5), (9, 5), (None, 5), (2, 2), (3, 2), (4, 4)}
    assert s.find(df.limit(0)).count() == 0


def test_links_through_rows_without_id(spark):
    fps = [(5, 0), (None, 7), (9, 63), (None, 1 << 40), (3, -1)]
    out = {(r.doc_id, r.fp, r.component_id) for r in s.components_of(spark.createDataFrame(fps, "doc_id long, fp long")).collect()}
    assert out == {(5, 0, 5), (None, 7, 5), (9, 63, 5), (None, 1 << 40, 5), (3, -1, 3)}


def jaccard(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            other = list(words)
            for _ in range(rng.randint(1, 5)):
                other[rng.randrange(len(other))] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(other))
    n = len(texts)
    label = list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in range(n):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in s.drop_near_duplicates(df).collect()}
    want = {i for i in range(n) if label[i] == i}
    assert len(pairs) > 50 and want <= kept and len(kept - want) <= 0.05 * len(pairs)


def test_rows_are_dropped_one_by_one(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (None, a, 3), (None, "c d", 4), (7, "e f", 5), (7, "e f", 5), (8, None, 6), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.k for r in kept.collect()) == [0, 2, 4, 5, 6]
    assert s.drop_near_duplicates(df.limit(0)).count() == 0
    assert {r.doc_id for r in s.drop_near_duplicates(spark.createDataFrame([("y", a), ("x", a + " more")], "doc_id string, text string")).collect()} == {"x"}


def test_only_texts_within_the_complete_distance_are_looked_at(spark, monkeypatch):
    texts = [" ".join(f"w{k}_{i}" for i in range(60)) for k in range(8)]
    texts.append(texts[0] + " more")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    looked, described = [], s._described
    # all meet in one bucket, as if their first words were alike
    monkeypatch.setattr(s, "_wide_buckets", lambda distinct: distinct.selectExpr("h", "0L AS gate", "1L AS bucket"))
    monkeypatch.setattr(s, "_described", lambda r, with_sets: (looked.append(r.count()) if with_sets else None, described(r, with_sets))[1])
    assert sorted(r.doc_id for r in s.drop_near_duplicates(rows).collect()) == list(range(8))
    assert looked == [2]


def test_fingerprints_that_share_a_segment_by_chance_rarely_pass_the_gate(spark):
    rng = random.Random(12)
    signed = lambda: rng.getrandbits(64) - (1 << 63)
    rows = [(h, [signed() for _ in range(s.WIDE_WORDS)]) for h in range(3000)]
    # a near copy of each of the first: one bit differs in every word
    rows += [(3000 + h, [w ^ 1 << rng.randrange(60) for w in words]) for h, words in rows[:50]]
    met = s._wide_buckets(spark.createDataFrame(rows, "h long, words array<long>"))
    close = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.h") < F.col("r.h"))
    gate = F.bit_count(F.col("l.gate").bitwiseXOR(F.col("r.gate"))) <= s.GATE_BITS
    pairs = {(r[0], r[1]): r[2] for r in met.alias("l").join(met.alias("r"), close).groupBy("l.h", "r.h").agg(F.max(gate)).collect()}
    copies = {(h, 3000 + h) for h in range(50)}
    assert copies <= {p for p, passed in pairs.items() if passed}
    assert len(pairs) > 500 and sum(passed for p, passed in pairs.items() if p not in copies) < 10
