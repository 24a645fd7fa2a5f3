import numpy as np
from pyspark.sql import functions as F

from quillon.llm import language_id as li

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9


def test_proportions_of_a_mixture():
    rng = np.random.default_rng(1)
    a, b = (rng.dirichlet(np.full(50, 0.1)) for _ in range(2))
    counts = rng.multinomial(20000, 0.3 * a + 0.7 * b).astype(float)
    probs = np.stack([a, b], axis=1) + 1e-9
    share, value = li.MixtureModel._fit(counts, probs, rounds=200)
    grid = np.linspace(0.01, 0.99, 99)
    brute = grid[np.argmax([counts @ np.log(probs @ np.array([g, 1 - g])) for g in grid])]
    assert abs(share[0] - brute) < 0.02 and value >= li.MixtureModel._fit(counts, probs, rounds=2)[1]


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", 0.5), (1, "the cat and the dog", "en", 0.5), (2, None, "en", 0.1), (3, "12 !!", None, 0.2), (4, "le chat et la souris " * 3000, "fr", 0.3), (None, "the cat", "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = {(r.doc_id, r.lang_pred, r.score > 0) for r in li.identify(df).collect()}
    assert (2, "und", False) in out and (3, "und", False) in out and any(r[0] is None for r in out)
    kept = li.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 4, None}
    assert li.identify(df.limit(0)).count() == 0
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in li.identify(nothing).collect()} == {"und"}
    assert {r.doc_id for r in li.keep_identified(nothing).collect()} == {1, 4, None}


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(8)] + [(20, "½ ² Ⅷ", "en"), (21, "²", None), (22, "日本", None)]
    out = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[20] == out[21] == ("und", 0.0) and out[22][0] == "en"


def test_every_language_is_learned_and_ties_go_to_the_smaller_name(spark):
    rows = [(i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'bcdfghjklmnp'[i // 26]} " * 30, f"l{i:03d}") for i in range(250)]
    model = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == 250 and model.infer(rows[249][1])[0] == "l249"
    twins = [(1, "same words here", "b"), (2, "same words here", "a")]
    model = li.learn(spark.createDataFrame(twins, "doc_id long, text string, lang string"), F.lit(True))
    assert model.infer("same words")[0] == "a"


def test_the_set_has_the_best_penalised_likelihood():
    rng = np.random.default_rng(4)
    counts = rng.dirichlet(np.full(li.BUCKETS, 0.01), size=3) * 1e5
    model = li.MixtureModel(["a", "b", "c"], counts)
    text = "some words of no language in particular, to be read as they are " * 20
    lang, score, size, _ = model.infer(text)
    seen = np.bincount(li.trigrams(text), minlength=li.BUCKETS)
    at = np.flatnonzero(seen)
    order = np.argsort(-model._fit(seen[at].astype(float), model.probs[at])[0], kind="stable")
    values = []
    for k in (1, 2, 3):
        share, likelihood = model._fit(seen[at].astype(float), model.probs[at][:, order[:k]])
        values.append((likelihood - li.PENALTY * (k - 1) * np.log(seen.sum() + 1), k, share))
    best = max(values, key=lambda v: v[0]) if values[1][0] > values[0][0] else values[0]
    assert size == best[1] and abs(score - best[2].max()) < 1e-12
