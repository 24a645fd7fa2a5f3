"""Language identification by multilingual mixture inference.

Every language is a distribution over hashed byte trigrams of lower-cased text in which everything but
letters counts as white space. A document's language proportions maximise its likelihood under a mixture
of these distributions and are found by expectation-maximisation. The language set is chosen by penalised
likelihood among the sets of the k most present languages, and the prediction is the set's most present
language.

Learning uses the rows that `training` keeps and of these a sample of about TRAIN_DOCS_PER_LANGUAGE whole
documents for each value of lang, chosen by a hash of the id and the text; every value of lang is learned. The model takes
BUCKETS numbers for each. Scoring reads every whole text; the score is the prediction's proportion in the chosen set.

Defined results: a text that is null or has no letter gives `und` and score 0, as does any text where
nothing can be learned; ties go to the smaller lang value; repeated rows give equal rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import hash_limit, remainder, small_batches

TRAIN_DOCS_PER_LANGUAGE = 4000
BUCKETS = 1 << 16
SMOOTHING = 0.1
ROUNDS = 12
#: Cost of one more language, in units of the logarithm of the number of trigrams; trigrams overlap,
#: so they count for less than independent observations.
PENALTY = 3.0
UNKNOWN = "und"

_CLASS = np.full(256, 32, dtype=np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigrams(text: str) -> np.ndarray:
    """The bucket of every trigram of the whole text."""
    x = _CLASS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    packed = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (packed * np.uint32(2654435761)) >> np.uint32(16)


class MixtureModel:
    """languages: sorted names; counts: languages x BUCKETS trigram counts."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.probs = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T) if languages else np.zeros((BUCKETS, 0))

    @staticmethod
    def _fit(counts: np.ndarray, probs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of the mixture of the columns of probs."""
        k = probs.shape[1]
        share = np.full(k, 1.0 / k)
        if k == 1:
            return share, float(counts @ np.log(probs[:, 0]))
        total = counts.sum()
        for _ in range(rounds):
            share = share * ((counts / (probs @ share)) @ probs) / total
        return share, float(counts @ np.log(probs @ share))

    def infer(self, text: str | None) -> tuple[str, float, int, float]:
        """(language, its proportion, size of the language set, bits above a uniform model per trigram)."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0, 0.0
        seen = np.bincount(trigrams(text), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        counts, probs = seen[at].astype(np.float64), self.probs[at]
        share, _ = self._fit(counts, probs)
        order = np.argsort(-share, kind="stable")
        total = counts.sum()
        best, best_value, best_set = None, -np.inf, None
        for k in range(1, len(order) + 1):
            chosen = order[:k]
            own, likelihood = self._fit(counts, probs[:, chosen])
            value = likelihood - PENALTY * (k - 1) * np.log(total + 1)
            if value <= best_value:
                break
            best, best_value, best_set = own, value, (chosen, likelihood)
        chosen, likelihood = best_set
        top = chosen[np.lexsort((chosen, -best))[0]]
        fit = likelihood / total / np.log(2) + np.log2(BUCKETS)
        return self.languages[top], float(min(1.0, max(0.0, best.max()))), len(chosen), float(fit)


def learn(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> MixtureModel:
    """The model of the rows for which training holds and lang and text are not null."""
    rows = docs.filter(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(lang).count().collect()  # one row for each language
    languages = sorted(r[0] for r in sizes)
    if not languages:
        return MixtureModel([], np.zeros((0, BUCKETS)))
    # a hash decides whether a document is in the sample
    limit = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(hash_limit(per_language, r[1])))])
    sample = rows.filter(F.xxhash64(F.col(key), F.col(text), F.lit("language")) <= limit[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    index = {name: i for i, name in enumerate(languages)}

    def count(batches):
        counts = np.zeros((len(index), BUCKETS), dtype=np.int64)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[index[name]] += np.bincount(trigrams(body), minlength=BUCKETS)
        which, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[which, bucket])], names=["l", "b", "n"])

    # at most BUCKETS sums a language come to the driver
    sums = sample.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["l"].to_numpy(), sums["b"].to_numpy()] = sums["n"].to_numpy()
    return MixtureModel(languages, counts)


def predict(docs: DataFrame, model: MixtureModel, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, lang_pred, score, n_languages and fit (bits per trigram above a uniform model) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    chosen = docs.select(F.struct(*[docs[c] for c in carry]).alias("carry"), docs[text].alias("text"))

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.infer(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.string(), pa.float64(), pa.int32(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["carry", "lang_pred", "score", "n_languages", "fit"])

    kind = chosen.schema["carry"].dataType.simpleString()
    out = chosen.mapInArrow(run, f"carry {kind}, lang_pred string, score double, n_languages int, fit double")
    return out.select(*[F.col("carry")[c].alias(c) for c in carry], "lang_pred", "score", "n_languages", "fit")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and more for every row of docs; rows with remainder 2 are held out."""
    model = learn(docs, remainder("doc_id", 4) != 2)
    return predict(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_languages", "fit")


def keep_identified(docs: DataFrame, least_score: float = 0.3, least_fit: float = 0.0) -> DataFrame:
    """The rows of docs in a learned language: not `und`, a proportion of least_score or more, and trigrams
    likelier than under a uniform model. With nothing to learn from, every row that has a letter stays."""
    model = learn(docs, remainder("doc_id", 4) != 2)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, carry=("row",))
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score) & (F.col("fit") >= least_fit)
    return judged.filter(good).select(*[F.col("row")[c].alias(c) for c in docs.columns])
