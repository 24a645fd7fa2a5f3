"""Toxicity by maximum-scoring segment search.

Tokens are runs of letters in lower case. A feature is a token or its beginning of a few letters; its weight is
its log-odds of occurring in the distinct lines of toxic and of other labelled documents, under an informative Dirichlet prior, kept
where it is significant, less a drift that makes a clean text's expected weight negative. A token takes the
weight of its most specific feature that has one. One linear scan over a document's weights finds every maximal
scoring segment. Segment scores are put on the scale of extreme-value statistics, S' = lambda*S - ln(K*n),
with lambda from the weights' moment equation on clean documents and K from their maxima; a logistic curve
fitted on the training rows turns the best and the summed significant S' into a score from 0 to 1.

Learning uses labelled rows that `training` keeps, and of these a sample of about TRAIN_DOCS_PER_LABEL whole
documents of each label, chosen by a hash of the id. Scoring reads every whole text.

Defined results: null and empty texts have no segment and get the score of such texts; a label that is null
teaches nothing; if a document has several labels it is toxic when one of them is; without a toxic or a
clean training row every score is 0; repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import re
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import hash_limit, remainder, small_batches
from quillon.session import checkpointed

TRAIN_DOCS_PER_LABEL = 5000
#: Strength of the prior, in occurrences, spread over the features as those of all documents are.
PRIOR_COUNT = 5000.0
#: Least count of a feature, and least z-score of its log-odds, for a weight of its own.
LEAST_COUNT = 5
LEAST_Z = 3.7
LEAST_PRIOR = 0.5
#: Lengths of the word beginnings that stand in for words too rare to have a weight of their own.
STEMS = (5, 4)
DRIFT = 0.1
#: Segments with S' above this count as significant: e**-2 such segments are expected in a clean text.
SIGNIFICANT = 2.0
THRESHOLD = 0.3

TOKENS = re.compile(r"[^\W\d_]+")


def features_of(token: str) -> list[str]:
    """The token and its beginnings, most specific first."""
    return [token, *[f"^{token[:n]}" for n in STEMS if len(token) >= n]]


class _Weights(dict):
    """Weights by token; a token seen for the first time takes the weight of its most specific feature."""

    def __init__(self, by_feature: dict[str, float]):
        super().__init__()
        self.by_feature = by_feature

    def __missing__(self, token: str) -> float:
        if len(self) > _REMEMBERED:
            self.clear()
        self[token] = w = next((self.by_feature[f] for f in features_of(token) if f in self.by_feature), -DRIFT)
        return w


#: Tokens whose weight a worker remembers.
_REMEMBERED = 200_000


def maximal_segments(weights) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of the weights, left to right, in linear time.

    A segment is maximal if all its proper prefixes and suffixes score less than it and no larger segment
    has this property. Candidates form a list; each new positive weight becomes a candidate that is merged
    with earlier ones while that raises its score.
    """
    found: list[list[float]] = []  # start, end, total before start, total at end
    total = 0.0
    links: list[int] = []  # the nearest earlier candidate with a smaller total before its start, or -1
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        item = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = links[j]
            if j < 0 or found[j][3] >= item[3]:
                found.append(item)
                links.append(j)
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:], links[j:]
    return [(int(s), int(e), r - l) for s, e, l, r in found]


class SegmentModel:
    """weights: of features; tokens without one weigh -DRIFT; lam, k: extreme-value parameters; curve: of the logistic."""

    def __init__(self, weights: dict[str, float], lam: float = 1.0, k: float = 1.0, curve=(0.0, 0.0, 0.0), scale: float | None = None):
        self.weights, self.lam, self.k, self.curve, self.scale = weights, lam, k, tuple(curve), scale

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_of"}

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Segments in token positions and the number of tokens of the whole text."""
        tokens = TOKENS.findall((text or "").lower())
        if "_of" not in self.__dict__:
            self._of = _Weights(self.weights)
        weights = np.fromiter(map(self._of.__getitem__, tokens), dtype=np.float64, count=len(tokens))
        up = np.flatnonzero(weights > 0)
        if not len(up):
            return [], len(tokens)
        # the runs between positive weights only matter by their sums
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        gaps = sums[up[1:]] - sums[up[:-1] + 1]
        short = np.empty(2 * len(up) - 1)
        short[0::2], short[1::2] = weights[up], gaps
        return [(int(up[s // 2]), int(up[(e - 1) // 2]) + 1, r) for s, e, r in maximal_segments(short.tolist())], len(tokens)

    def scaled(self, text: str | None) -> list[tuple[int, int, float]]:
        """The segments with S' in place of their scores."""
        found, n = self.segments(text)
        shift = log(self.k * max(n, 1))
        return [(a, b, self.lam * s - shift) for a, b, s in found]

    @staticmethod
    def _summed(scaled: list[tuple[int, int, float]]) -> tuple[float, float]:
        if not scaled:
            return 0.0, 0.0
        return log1p(max(0.0, max(s for _, _, s in scaled) + 10.0)), log1p(sum(s for _, _, s in scaled if s > SIGNIFICANT))

    def features(self, text: str | None) -> tuple[float, float]:
        """The best S' and the sum of the significant ones, both 0 or more and on a log scale."""
        return self._summed(self.scaled(text))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score and the significant segments of a text."""
        if self.scale is None:
            return 0.0, []
        scaled = self.scaled(text)
        a, b = self._summed(scaled)
        x = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1.0 / (1.0 + exp(-max(-50.0, min(50.0, x)))), [s for s in scaled if s[2] > SIGNIFICANT]

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]


def _lambda(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * weight)) = 1; 1 if there is none."""
    if not (weights > 0).any() or (weights @ shares) >= 0:
        return 1.0
    low, high = 1e-9, 1.0
    while shares @ np.exp(np.minimum(high * weights, 600.0)) < 1.0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if shares @ np.exp(np.minimum(mid * weights, 600.0)) < 1.0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, training: Column, per_label: int = TRAIN_DOCS_PER_LABEL) -> SegmentModel:
    """The model of the labelled rows of docs for which training holds."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    known = known.filter(training)
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return SegmentModel({})
    limit = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(hash_limit(per_label, n)))])
    chosen = known.filter(F.xxhash64("doc_id", F.lit("toxicity")) <= limit[F.col("toxic")])
    # about 2 * TRAIN_DOCS_PER_LABEL ids, whatever the corpus: they go to the documents, and the sample is kept
    sample = checkpointed(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")))

    def present(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name in {f for token in set(TOKENS.findall(body.lower())) for f in features_of(token)}:
                    counts.setdefault(name, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]], names=["feature", "c", "t"])

    # copies of a document teach once: a line counts once, and as clean if any clean document has it
    lines = sample.select("toxic", F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.min("toxic").alias("toxic")).select("toxic", "line")
    counts = checkpointed(lines.mapInArrow(present, "feature string, c long, t long").groupBy("feature").agg(F.sum("c").alias("c"), F.sum("t").alias("t")))
    sums = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not sums or not sums["t"] or not sums["c"]:
        return SegmentModel({})
    # significant features alone come to the driver
    prior = F.greatest(F.lit(LEAST_PRIOR), PRIOR_COUNT * (F.col("t") + F.col("c")) / F.lit(float(sums["t"] + sums["c"])))
    a, b = F.col("t") + prior, F.col("c") + prior
    delta = F.log(a / (F.lit(sums["t"] + PRIOR_COUNT) - a)) - F.log(b / (F.lit(sums["c"] + PRIOR_COUNT) - b))
    scored = counts.filter(F.col("t") + F.col("c") >= LEAST_COUNT).select("feature", "c", delta.alias("delta"), (delta / F.sqrt(1 / a + 1 / b)).alias("z"))
    own = scored.filter(F.abs("z") >= LEAST_Z).orderBy("feature").toPandas()
    weight = np.append(own["delta"].to_numpy(dtype=np.float64), 0.0) - DRIFT
    clean = np.append(own["c"].to_numpy(dtype=np.float64), max(0.0, float(sums["c"]) - float(own["c"].sum())))
    model = SegmentModel(dict(zip(own["feature"], weight[:-1].tolist(), strict=True)), _lambda(weight, clean / clean.sum()))
    shared = spark.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            found = [shared.value.segments(t) for t in batch.column(1).to_pylist()]
            best = [max((s for _, _, s in f), default=0.0) for f, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["toxic", "best", "n"])

    maxima = sample.mapInArrow(scan, "toxic int, best double, n long").filter("toxic = 0 AND best > 0 AND n > 0").agg(F.avg(F.col("best")).alias("m"), F.avg(F.log("n")).alias("l")).first()
    # the mean of an extreme-value law is (ln(K n) + 0.5772) / lambda
    if maxima and maxima["m"] is not None:
        model.k = exp(max(-30.0, min(30.0, model.lam * maxima["m"] - maxima["l"] - 0.5772)))
    shared = spark.sparkContext.broadcast(model)

    def describe(batches):
        for batch in batches:
            found = [shared.value.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]], names=["toxic", "a", "b"])

    # two labels' samples: about 2 * TRAIN_DOCS_PER_LABEL rows of three numbers
    points = sample.mapInArrow(describe, "toxic int, a double, b double").toPandas().sort_values(["toxic", "a", "b"])
    x = np.column_stack([np.ones(len(points)), points["a"].to_numpy(), points["b"].to_numpy()])
    y = points["toxic"].to_numpy(dtype=np.float64)
    # the sample has its own share of toxic rows; the rows' true share enters by the intercept
    model.curve = _logistic(x, y)
    shift = log(sizes[1] / sizes[0]) - log(max(1.0, y.sum()) / max(1.0, len(y) - y.sum()))
    model.curve[0] += shift
    model.scale = 1.0
    return model


def score(docs: DataFrame, model: SegmentModel) -> DataFrame:
    """doc_id, held_out, score, predicted and passages (start, end, s: token positions and S' of the significant segments) for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.judge(t) for t in batch.column(1).to_pylist()]
            passages = pa.array([p for _, p in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("s", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), passages], names=["doc_id", "score", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<start:int,end:int,s:double>>")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of a model that learns from rows whose remainder is not 2."""
    return score(docs, learn(docs, labels, remainder("doc_id", 4) != 2))
