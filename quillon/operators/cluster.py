"""Topics: term weights, coherence and diversity of words, and a declared substitute for clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import tokens


def topic_terms(docs: DataFrame, topic: str, text: str = "text", top: int = 10) -> DataFrame:
    """(topic, term, weight, rank): square root of the term's share in the topic times ln(1 + A / f), where A is
    the mean number of words of a topic and f the term's count in all topics; ties by term."""
    words = docs.filter(F.col(topic).isNotNull()).select(topic, F.explode(tokens(F.lower(text))).alias("term"))
    counts = words.groupBy(topic, "term").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(topic).agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    often = counts.groupBy("term").agg(F.sum("n").alias("f"))
    out = counts.join(F.broadcast(sizes), topic).join(often, "term").crossJoin(F.broadcast(mean))  # one row
    weight = F.round(F.sqrt(F.col("n") / F.col("size")) * F.log1p(F.col("mean") / F.col("f")), 6)
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("weight"), "term"))
    return out.withColumn("weight", weight).withColumn("rank", rank).filter(F.col("rank") <= top).select(topic, "term", "weight", "rank")


def dictionary(docs: DataFrame, text: str = "text", least_docs: int = 2) -> DataFrame:
    """(term, df) of terms in least_docs documents or more."""
    terms = docs.select(F.explode(F.array_distinct(tokens(F.lower(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least_docs)


def coherence(docs: DataFrame, terms: DataFrame, topic: str, text: str = "text") -> DataFrame:
    """(topic, coherence): mean normalised pointwise mutual information of a topic's term pairs over documents.

    terms holds a few terms for each topic; documents meet them by broadcast of that bounded table."""
    n = docs.count()
    wanted = terms.select("term").distinct()
    hits = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.lower(text)))).alias("term")).join(F.broadcast(wanted), "term")
    sets = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("t"))
    single = hits.groupBy("term").agg(F.count("*").alias("c"))
    pair = sets.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c_ab"))
    left = terms.select(topic, F.col("term").alias("a"))
    asked = left.join(terms.select(topic, F.col("term").alias("b")), topic).filter("a < b")
    full = asked.join(pair, ["a", "b"], "left").join(single.select(F.col("term").alias("a"), F.col("c").alias("c_a")), "a").join(single.select(F.col("term").alias("b"), F.col("c").alias("c_b")), "b")
    p = F.col("c_ab") / F.lit(float(max(n, 1)))
    npmi = F.when(F.col("c_ab").isNull(), -1.0).when(p == 1.0, 1.0).otherwise(F.log(p / (F.col("c_a") * F.col("c_b") / F.lit(float(max(n, 1)) ** 2))) / -F.log(p))
    return full.groupBy(topic).agg(F.round(F.avg(npmi), 6).alias("coherence"))


def cluster(vectors: DataFrame, k: int, dims: int | None = None, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """vectors with a topic: k-means on unit vectors, after PCA if dims is given.

    A substitute: neither manifold projection nor density clustering has an equivalent here, so topics are
    not comparable with those, and no row is noise."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector

    data = vectors.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    data = Normalizer(inputCol="_v", outputCol="_u").transform(data)
    column = "_u"
    if dims:
        data = PCA(k=dims, inputCol="_u", outputCol="_p").fit(data).transform(data)
        column = "_p"
    found = KMeans(k=k, seed=seed, featuresCol=column, predictionCol="topic").fit(data).transform(data)
    return found.select(*vectors.columns, "topic")


def grid_run(vectors: DataFrame, ks, dims) -> DataFrame:
    """One row for each configuration: number of topics, smallest topic, cost; a failure becomes an error row."""
    spark, rows = vectors.sparkSession, []
    for k in ks:
        for d in dims:
            try:
                sizes = [r["count"] for r in cluster(vectors, k, d).groupBy("topic").count().collect()]
                rows.append((k, d or 0, len(sizes), min(sizes), None))
            except Exception as e:  # noqa: BLE001  the grid goes on
                rows.append((k, d or 0, None, None, str(e)[:300]))
    return spark.createDataFrame(rows, "k int, dims int, n_topics int, smallest long, error string")
