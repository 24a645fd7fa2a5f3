"""The registered queries of the curation, audit and evaluation operators, and their SQL."""

from __future__ import annotations

import keyword

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions.code_similarity import code_similarity
from quillon.functions.python_code import complexity_of, documented_function, entry_point_anywhere, entry_point_at_margin, syntax_report
from quillon.functions.text_scores import forget_quality as forget_scores
from quillon.operators import cluster, compose, curate, experiments, harden, histogram, pairs, report, select
from quillon.plans import fixtures

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKS = r"regexp_extract_all(coalesce(text, ''), '\S+')"


@query(f"""WITH c AS (SELECT list_sort(list_distinct({TOKS})) AS toks, min(doc_id) AS rep, count(*) AS copies FROM documents GROUP BY 1),
d AS (SELECT * FROM c WHERE len(toks) > 0),
t AS (SELECT rep, copies, len(toks) AS n, unnest(toks) AS t FROM d),
p AS (SELECT a.rep AS i, b.rep AS j, a.n AS n, b.n AS m, a.copies AS n_i, b.copies AS n_j, count(*) AS s FROM t a JOIN t b ON a.t = b.t AND a.rep < b.rep GROUP BY ALL)
SELECT i, j, round(s::DOUBLE / (n + m - s), 6) AS jaccard,
  CASE WHEN round(s::DOUBLE / (n + m - s), 12) >= 0.75 THEN 'HARD_FAIL' WHEN round(s::DOUBLE / (n + m - s), 12) >= 0.6 THEN 'REVIEW' ELSE 'CROSS' END AS flag, n_i, n_j
FROM p WHERE round(s::DOUBLE / (n + m - s), 12) >= 0.6""")
def jaccard_pairs_above(spark, sf_dir):
    return pairs.jaccard_pairs(table(spark, sf_dir, "documents"), 0.6)


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(list_distinct({TOKS}))) AS class_id, count(*) OVER (PARTITION BY list_sort(list_distinct({TOKS}))) AS n FROM documents")
def token_set_classes(spark, sf_dir):
    return pairs.class_members(table(spark, sf_dir, "documents"))


@query("SELECT * EXCLUDE (text, n) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup_keep_first(spark, sf_dir):
    return curate.dedup_keep_first(table(spark, sf_dir, "documents"), "text", "doc_id").drop("text")


@query("SELECT min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return curate.duplicate_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(rf"SELECT doc_id, substring(array_to_string({TOKS}, ' '), 1, 120) AS preview, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE regexp_matches(text, '\S')")
def nonblank_preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(tx.not_blank(F.col("text")))
    counts = docs.groupBy("text").agg(F.count("*").alias("copies"))
    return docs.select("doc_id", "text").join(counts, "text").select("doc_id", tx.preview(F.col("text")).alias("preview"), "copies")


@query("SELECT coalesce(lang, 'missing') AS lang, coalesce(source, 'missing') AS source, count(*) AS n FROM documents GROUP BY 1, 2")
def source_lang_counts(spark, sf_dir):
    return curate.counts_with_default(table(spark, sf_dir, "documents"), "lang", "source")


@query(f"""WITH b AS (SELECT item_id, {TOKS} AS x FROM benchmark), p AS (SELECT l.item_id AS i, r.item_id AS j, l.x AS a, r.x AS b FROM b l JOIN b r ON r.item_id = l.item_id + 1)
SELECT i, j, len(list_distinct(a)) AS unique_left, len(list_distinct(b)) AS unique_right, len(list_intersect(a, b)) AS shared,
  len(list_distinct(list_concat(a, b))) AS "union", len(a) AS total_left, len(b) AS total_right FROM p""")
def token_overlap_counts(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("x"))
    right = items.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("j"), F.col("x").alias("y"))
    long = lambda s: [F.col(f"o.{c}").cast("long").alias(c) for c in s]
    out = items.join(right, "item_id").select(F.col("item_id").alias("i"), "j", pairs.overlap_counts(F.col("x"), F.col("y")).alias("o"))
    return out.select("i", "j", *long(("unique_left", "unique_right", "shared", "union", "total_left", "total_right")))


@query(f"WITH q AS ({SQL['jaccard_pairs_above']}) SELECT * FROM q ORDER BY jaccard DESC, i, j LIMIT 1")
def jaccard_argmax(spark, sf_dir):
    return pairs.first_largest(jaccard_pairs_above(spark, sf_dir), "jaccard")


_J = f"""WITH b AS (SELECT item_id, list_distinct({TOKS}) AS x FROM benchmark),
p AS (SELECT l.x AS a, r.x AS b, CASE WHEN len(l.x) + len(r.x) = 0 THEN 1.0 ELSE len(list_intersect(l.x, r.x))::DOUBLE / len(list_distinct(list_concat(l.x, r.x))) END AS s,
  CASE WHEN greatest(len(l.x), len(r.x)) = 0 THEN 1.0 ELSE least(len(l.x), len(r.x))::DOUBLE / greatest(len(l.x), len(r.x)) END AS ratio
  FROM b l JOIN b r ON l.item_id < r.item_id)"""


def _benchmark_pairs(spark, sf_dir):
    """The benchmark's items in all pairs: a stated, bounded table (it does not grow with the corpus)."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("x"))
    right = F.broadcast(items.select(F.col("item_id").alias("j"), F.col("x").alias("y")))
    both = items.join(right, F.col("item_id") < F.col("j"))
    longer = F.greatest(F.size("x"), F.size("y"))
    ratio = F.when(longer == 0, 1.0).otherwise(F.least(F.size("x"), F.size("y")) / F.greatest(longer, F.lit(1)))
    return both.select(pairs.jaccard(F.col("x"), F.col("y")).alias("s"), ratio.alias("ratio"))


@query(_J + """, h AS (SELECT greatest(0, least(49, floor(round(s, 12) * 50)))::INTEGER AS bin, count(*) AS n FROM p GROUP BY 1)
SELECT i::INTEGER AS bin, round(i / 50.0, 6)::DOUBLE AS bin_left, round((i + 1) / 50.0, 6)::DOUBLE AS bin_right, round((i + 0.5) / 50.0, 6)::DOUBLE AS bin_center, coalesce(n, 0)::BIGINT AS n
FROM range(50) t(i) LEFT JOIN h ON h.bin = i""")
def jaccard_histogram_dense(spark, sf_dir):
    counts = _benchmark_pairs(spark, sf_dir).groupBy(histogram.clamped_bin(F.col("s"), 0.0, 1.0, 50).alias("bin")).agg(F.count("*").alias("n"))
    return histogram.dense(spark, counts, 0.0, 1.0, 50, "n")


@query(_J + """SELECT greatest(0, least(19, floor(round(s, 12) * 20)))::INTEGER AS jaccard_bin, greatest(0, least(19, floor(round(ratio, 12) * 20)))::INTEGER AS ratio_bin, count(*) AS n FROM p GROUP BY ALL""")
def joint_histogram(spark, sf_dir):
    bins = [histogram.clamped_bin(F.col(c), 0.0, 1.0, 20).alias(n) for c, n in (("s", "jaccard_bin"), ("ratio", "ratio_bin"))]
    return _benchmark_pairs(spark, sf_dir).groupBy(*bins).agg(F.count("*").alias("n"))


_SHINGLES = r"""SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i
  FROM (SELECT {key}, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM {t}))"""
_CONTAINMENT = f"""WITH d AS ({_SHINGLES.format(key='doc_id', t='documents')}), b AS ({_SHINGLES.format(key='item_id', t='benchmark')}),
z AS (SELECT item_id, count(*) AS size FROM b GROUP BY 1), h AS (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN b USING (s) GROUP BY ALL),
m AS (SELECT doc_id, max(hits::DOUBLE / size) AS similarity FROM h JOIN z USING (item_id) GROUP BY 1)"""


@query(_CONTAINMENT + " SELECT doc_id, round(coalesce(similarity, 0.0), 6) AS similarity FROM documents LEFT JOIN m USING (doc_id) WHERE coalesce(similarity, 0.0) < 0.75")
def contamination_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = curate.containment(docs, table(spark, sf_dir, "benchmark"))
    scored = docs.select("doc_id").join(found, "doc_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return scored.filter(curate.uncontaminated(F.col("similarity"))).select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(_CONTAINMENT + " SELECT doc_id FROM m WHERE similarity >= 1.0")
def whole_item_contamination(spark, sf_dir):
    found = curate.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.filter("similarity >= 1.0").select("doc_id")


@query("""SELECT source, count(*) AS total, count(quality) AS labelled, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed,
coalesce(round(count(*) FILTER (quality = 1)::DOUBLE / nullif(count(quality), 0), 6), 0.0) AS pass_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_join_validity(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    passed = F.count_if(F.col("quality") == 1)
    rate = F.coalesce(F.round(F.try_divide(passed.cast("double"), F.count("quality")), 6), F.lit(0.0))
    return joined.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), passed.alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), rate.alias("pass_rate"))


@query("SELECT d.doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def drop_failed_ids(spark, sf_dir):
    return curate.drop_failed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")


@query("SELECT (i - 1)::INTEGER AS dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def mean_vector(spark, sf_dir):
    return pairs.mean_vector(table(spark, sf_dir, "embeddings")).select("dim", F.round("mean", 6).alias("mean"))


_Z = """WITH m AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x::DOUBLE) AS m FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)),
c AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS raw, list_transform(embedding, lambda x, i: x::DOUBLE - m[i]) AS c FROM embeddings, m),
z AS (SELECT vec_id, label, raw, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-12)) AS z FROM c),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS la, b.label AS lb, list_dot_product(a.z, b.z) AS s, list_dot_product(a.raw, b.raw) AS r FROM z a JOIN z b ON a.vec_id < b.vec_id)"""
_PAIR = " SELECT i, j, round(s, 6) AS centered_score, round(r, 6) AS raw_score, CASE WHEN s >= 0.5 THEN 'HARD_FAIL' WHEN s >= 0.45 THEN 'REVIEW' ELSE 'CROSS' END AS flag FROM p WHERE s >= 0.4"


@query(_Z + _PAIR)
def centered_cosine_pairs(spark, sf_dir):
    return pairs.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.4, hard=0.5, review=0.45)


@query(_Z + _PAIR + " AND la IS DISTINCT FROM lb")
def cross_label_pairs(spark, sf_dir):
    return pairs.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.4, label="label", hard=0.5, review=0.45)


_BIN = "least(99, floor(round((round({c}, 12) + 1) / 2, 12) * 100))::INTEGER"
_HIST = _Z + f""", h AS (SELECT bin, sum(c)::BIGINT AS centered_count, sum(r)::BIGINT AS raw_count FROM (
  SELECT {_BIN.format(c='s')} AS bin, 1 AS c, 0 AS r FROM p WHERE round(s, 12) BETWEEN -1 AND 1 UNION ALL SELECT {_BIN.format(c='r')}, 0, 1 FROM p WHERE round(r, 12) BETWEEN -1 AND 1) GROUP BY 1),
d AS (SELECT i::INTEGER AS bin, round(-1 + i * 0.02, 6)::DOUBLE AS bin_left, round(-1 + (i + 1) * 0.02, 6)::DOUBLE AS bin_right, round(-1 + (i + 0.5) * 0.02, 6)::DOUBLE AS bin_center,
  coalesce(centered_count, 0)::BIGINT AS centered_count, coalesce(raw_count, 0)::BIGINT AS raw_count FROM range(100) t(i) LEFT JOIN h ON h.bin = i)"""


@query(_HIST + " SELECT * FROM d")
def cosine_histograms(spark, sf_dir):
    return histogram.dense(spark, pairs.cosine_histogram(table(spark, sf_dir, "embeddings")), -1.0, 1.0, 100, "centered_count", "raw_count")


def _stat_sql() -> str:
    p = lambda q, n: f"round(max(CASE WHEN upto >= total * {q} AND upto - n < total * {q} THEN bin_left + (total * {q} - (upto - n)) / n * (bin_right - bin_left) END), 6) AS {n}"
    f = lambda t: f"round(sum(CASE WHEN bin_center >= {t} THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS frac_{int(t * 100)}"
    return _HIST + f""", l AS (SELECT 'centered' AS space, centered_count AS n, bin_left, bin_right, bin_center FROM d UNION ALL SELECT 'raw', raw_count, bin_left, bin_right, bin_center FROM d),
u AS (SELECT *, sum(n) OVER (PARTITION BY space) AS total, sum(n) OVER (PARTITION BY space ORDER BY bin_left ROWS UNBOUNDED PRECEDING) AS upto FROM l WHERE n > 0)
SELECT space, sum(n)::BIGINT AS count, round(min(bin_left), 6) AS min, {', '.join(p(q, n) for q, n in ((0.01, 'p1'), (0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.9, 'p90'), (0.99, 'p99')))},
round(sum(n * bin_center) / sum(n), 6) AS mean, round(max(bin_right), 6) AS max,
round(sqrt(greatest(sum(n * bin_center * bin_center) / sum(n) - (sum(n * bin_center) / sum(n)) ** 2, 0)), 6) AS std, {', '.join(map(f, (0.5, 0.6, 0.75)))} FROM u GROUP BY space"""


@query(_stat_sql())
def histogram_statistics(spark, sf_dir):
    h = cosine_histograms(spark, sf_dir)
    spaces = F.array(*[F.struct(F.lit(s).alias("space"), F.col(f"{s}_count").alias("n")) for s in ("centered", "raw")])
    return histogram.statistics(h.select("bin_left", "bin_right", "bin_center", F.inline(spaces)), ["space"])


@query("""WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n
  FROM embeddings a CROSS JOIN embeddings b GROUP BY ALL),
r AS (SELECT vec_id, own, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY ALL)
SELECT own AS label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM r WHERE (SELECT count(DISTINCT own) BETWEEN 2 AND count(*) - 1 FROM r) GROUP BY 1""")
def silhouette_by_label(spark, sf_dir):
    return pairs.silhouette(table(spark, sf_dir, "embeddings"), "label")


@query(r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT lang, sum(n) AS size FROM c GROUP BY 1), f AS (SELECT term, sum(n) AS f FROM c GROUP BY 1),
x AS (SELECT lang, term, round(sqrt(n / size) * ln(1 + (SELECT avg(size) FROM s) / f), 6) AS weight FROM c JOIN s USING (lang) JOIN f USING (term))
SELECT lang, term, weight, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM x) WHERE rank <= 10""")
def ctfidf_top_terms(spark, sf_dir):
    return cluster.topic_terms(table(spark, sf_dir, "documents"), "lang")


@query(r"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\S+'))) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 2")
def term_dictionary(spark, sf_dir):
    return cluster.dictionary(table(spark, sf_dir, "documents"))


@query()
def topic_coherence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return cluster.coherence(docs, cluster.topic_terms(docs, "lang"), "lang")


@query()
def cluster_grid(spark, sf_dir):
    return cluster.grid_run(table(spark, sf_dir, "embeddings"), (5, 10), (None, 8))


_GRID = """WITH g AS (SELECT p_brand, round(avg(p_retailprice), 4) AS coherence, round(stddev_samp(p_size)::DOUBLE, 4) AS silhouette, count(*) AS n_topics FROM part GROUP BY 1)"""


def _grid(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    grid = part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("coherence"), F.round(F.stddev_samp("p_size"), 4).alias("silhouette"), F.count("*").alias("n_topics"))
    return select.valid_configs(grid, "coherence", "silhouette", topics="n_topics", least=2)


@query(_GRID + " SELECT * FROM g a WHERE n_topics >= 2 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.coherence >= a.coherence AND b.silhouette >= a.silhouette AND (b.coherence > a.coherence OR b.silhouette > a.silhouette))")
def pareto_frontier(spark, sf_dir):
    return select.pareto(_grid(spark, sf_dir), "coherence", "silhouette")


@query(_GRID + """, m AS (SELECT *, min(coherence) OVER () AS a, max(coherence) OVER () AS b, min(silhouette) OVER () AS c, max(silhouette) OVER () AS d FROM g WHERE n_topics >= 2)
SELECT p_brand, coherence, silhouette, n_topics, round(0.5 * CASE WHEN b > a THEN (coherence - a) / (b - a) ELSE 0.5 END + 0.5 * CASE WHEN d > c THEN (silhouette - c) / (d - c) ELSE 0.5 END, 6) AS combined
FROM m ORDER BY combined DESC, p_brand LIMIT 1""")
def minmax_select_best(spark, sf_dir):
    scored = select.with_combined(_grid(spark, sf_dir), "coherence", "silhouette").withColumn("combined", F.round("combined", 6))
    return scored.orderBy(F.desc("combined"), "p_brand").limit(1)


@query("SELECT n::INTEGER AS n_neighbors, c::INTEGER AS n_components, s::INTEGER AS min_cluster_size, m::INTEGER AS min_samples FROM (VALUES (10),(15),(30)) a(n), (VALUES (5),(10)) b(c), (VALUES (10),(20),(40)) d(s), (VALUES (1),(5)) e(m)")
def config_grid(spark, sf_dir):
    return experiments.axes(spark, n_neighbors=(10, 15, 30), n_components=(5, 10), min_cluster_size=(10, 20, 40), min_samples=(1, 5))


@query("""WITH m AS (SELECT * FROM (VALUES ('qwen'),('llama'),('granite')) a(model), (VALUES ('ga'),('npo'),('prod')) b(method)), o AS (SELECT * FROM (VALUES ('interleaved'),('forget_first')) t(batch_order)), r AS (SELECT * FROM (VALUES ('half'),('full')) t(retain)),
j AS (SELECT 'rq1' AS setting, model, method, batch_order, '' AS retain FROM m, o UNION ALL SELECT 'rq2', model, method, '', retain FROM m, r UNION ALL SELECT 'rq3', model, method, batch_order, retain FROM m, o, r)
SELECT *, concat_ws('|', model, method, batch_order, retain) AS job FROM j""")
def job_matrix(spark, sf_dir):
    return experiments.job_matrix(spark)


@query(f"""WITH c AS (SELECT DISTINCT adapter, regexp_extract(path, '^(checkpoint-[0-9]+)/', 1) AS checkpoint FROM {fixtures.values(fixtures.PATHS, 'adapter, path')})
SELECT adapter, checkpoint, 'epoch-' || row_number() OVER (PARTITION BY adapter ORDER BY regexp_extract(checkpoint, '[0-9]+')::INTEGER) AS alias FROM c WHERE checkpoint <> ''""")
def checkpoint_alias(spark, sf_dir):
    return experiments.with_alias(experiments.choose(experiments.checkpoints(fixtures.paths(spark))))


@query(f"""WITH c AS (SELECT DISTINCT adapter, regexp_extract(path, '^(checkpoint-[0-9]+)/', 1) AS checkpoint FROM {fixtures.values(fixtures.PATHS, 'adapter, path')}),
n AS (SELECT *, row_number() OVER (PARTITION BY adapter ORDER BY regexp_extract(checkpoint, '[0-9]+')::INTEGER) AS pos FROM c WHERE checkpoint <> '')
SELECT adapter, checkpoint, split, true AS do_sample, 10 AS attempts FROM n, (VALUES ('forget'),('retain'),('approximate')) s(split) WHERE pos <= 2""")
def evaluation_configs(spark, sf_dir):
    return experiments.evaluation_configs(experiments.choose(experiments.checkpoints(fixtures.paths(spark)), first=2), 10)


_ATTEMPTS = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c, max(value) AS best FROM events GROUP BY 1"


@query(f"""WITH a AS ({_ATTEMPTS}) SELECT user_id, n, c, {', '.join(f"round(CASE WHEN n < {k} THEN NULL WHEN n - c < {k} THEN 1.0 ELSE 1.0 - list_product([(n - c - i)::DOUBLE / (n - i) FOR i IN range({k})]) END, 6) AS pass_{k}" for k in (1, 3, 5))} FROM a""")
def pass_at_k(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    return attempts.select("user_id", "n", "c", *[F.round(experiments.pass_at_k(F.col("n"), F.col("c"), k), 6).alias(f"pass_{k}") for k in experiments.reporting_points(5)])


@query("SELECT user_id, max(value) AS best, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def best_of_k(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("best"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH x AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT 'raw' AS kind, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY source
UNION ALL SELECT 'filtered', source, count(*), round(avg(n_chars), 6) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x) GROUP BY source""")
def aggregate_with_exclusions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    kept = experiments.exclude(docs, table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")
    summed = lambda df, kind: df.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).select(F.lit(kind).alias("kind"), "source", "n", "mean_chars")
    return summed(docs, "raw").unionByName(summed(kept, "filtered"))


_HALF = """SELECT o_custkey AS idx, 'c' || o_custkey AS function_name, count(*) FILTER (o_orderstatus = 'F') AS killed, count(*) FILTER (o_orderstatus <> 'F') AS survived, count(*) AS total_mutants,
 round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS mutation_score_pct FROM orders WHERE {where} GROUP BY 1"""


def _half(spark, sf_dir, where):
    killed, n = F.count_if(F.col("o_orderstatus") == "F"), F.count("*")
    return table(spark, sf_dir, "orders").filter(where).groupBy(F.col("o_custkey").alias("idx")).agg(
        killed.alias("killed"), F.count_if(F.col("o_orderstatus") != "F").alias("survived"), n.alias("total_mutants"), F.round(100.0 * killed / n, 1).alias("mutation_score_pct")
    ).withColumn("function_name", F.concat(F.lit("c"), F.col("idx").cast("string")))


_CUT = "o_orderdate < TIMESTAMP '1998-04-25 00:00:00'"
_COMPARED = f"""WITH b AS ({_HALF.format(where=_CUT)}), a AS ({_HALF.format(where='NOT ' + _CUT)}),
j AS (SELECT coalesce(b.idx, a.idx) AS idx, coalesce(a.function_name, b.function_name, '?') AS function_name, b.mutation_score_pct AS mutation_score_pct_before, a.mutation_score_pct AS mutation_score_pct_after,
 round(a.mutation_score_pct - b.mutation_score_pct, 6) AS delta_pp, (a.survived - b.survived)::DOUBLE AS delta_survived, b.killed::DOUBLE AS killed_before, a.killed::DOUBLE AS killed_after,
 b.total_mutants::DOUBLE AS total_mutants_before, a.total_mutants::DOUBLE AS total_mutants_after FROM b FULL JOIN a ON a.idx = b.idx)"""


@query(_COMPARED + " SELECT * FROM j")
def before_after_report(spark, sf_dir):
    compared = harden.compare(_half(spark, sf_dir, _CUT), _half(spark, sf_dir, f"NOT {_CUT}"))
    return compared.select(*[F.col(c).cast("double").alias(c) if t == "bigint" and c != "idx" else F.col(c) for c, t in compared.dtypes])


@query(_COMPARED + """ SELECT round(100.0 * sum(killed_before) / sum(total_mutants_before), 6) AS score_before, round(100.0 * sum(killed_after) / sum(total_mutants_after), 6) AS score_after, sum(delta_survived) AS delta_survived FROM j""")
def pooled_change(spark, sf_dir):
    return harden.pooled_change(before_after_report(spark, sf_dir))


def _log_sql() -> str:
    n = lambda src, p: f"coalesce(nullif(regexp_extract({src}, '{p}', 1), '')::INTEGER, 0)"
    progress = ", ".join(f"{n('last', mark + r'\s*([0-9]+)')} AS {name}" for name, mark in harden.MARKS.items())
    older = ", ".join(f"{n('results', rf'(?im)^{s}[^\n(]*\(([0-9]+)\)')} AS r_{s}" for s in harden.STATUSES)
    return f"""WITH l AS (SELECT *, coalesce(list_filter(string_split(run_log, chr(10)), lambda x: regexp_matches(x, '[0-9]+/[0-9]+.*🎉'))[-1], '') AS last FROM {fixtures.values(fixtures.LOGS, 'idx, run_log, results')})
SELECT idx::INTEGER AS idx, {progress}, {n('last', '[0-9]+/([0-9]+)')} AS total, {older} FROM l"""


@query(_log_sql())
def mutation_log_parse(spark, sf_dir):
    df = fixtures.logs(spark).select("idx", harden.progress_counts(F.col("run_log")).alias("p"), harden.result_counts(F.col("results")).alias("r"))
    return df.select("idx", "p.*", *[F.col(f"r.{s}").alias(f"r_{s}") for s in harden.STATUSES])


@query()
def mutation_ids(spark, sf_dir):
    return fixtures.logs(spark).select("idx", *[harden.ids_for(F.col("results"), s).alias(s.lower().replace(" ", "_")) for s in ("Survived", "No coverage")])


@query(rf"""WITH d AS (SELECT id::INTEGER AS id, list_transform(list_filter(string_split(diff, chr(10)), lambda x: (starts_with(x, '+') OR starts_with(x, '-')) AND NOT starts_with(x, '+++') AND NOT starts_with(x, '---')), lambda x: x[2:]) AS c FROM {fixtures.values(fixtures.DIFFS, 'id, diff')})
SELECT id, len(c) > 0 AND (len(list_filter(c, lambda x: NOT regexp_matches(x, '^\s*\w+\s*=\s*(".*"|''.*'')\s*$'))) = 0 OR len(list_filter(c, lambda x: trim(x) <> 'pass')) = 0) AS equivalent FROM d""")
def equivalent_mutants(spark, sf_dir):
    return fixtures.diffs(spark).select("id", harden.likely_equivalent(F.col("diff")).alias("equivalent"))


def _strip_sql() -> str:
    out = r"regexp_replace(text, '(?s)@\w+(\.\w+)*(\(.*?\))?', '', 'g')"
    for p, r in ((r"\b__\w+__\b", ""), (rf"\b({'|'.join(sorted(keyword.kwlist))})\b", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return f"SELECT doc_id, md5({out}) AS digest, length({out}) AS n FROM documents"


@query(_strip_sql())
def keyword_strip(spark, sf_dir):
    cut = tx.strip_keywords(F.col("text"), unicode=False)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cut.cast("binary")).alias("digest"), F.length(cut).cast("long").alias("n"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{tx.EMAIL}')) AS n_emails, nullif(regexp_extract(text, '{tx.TOKEN}', 1), '') AS secret FROM documents WHERE regexp_matches(text, '{tx.EMAIL}') OR regexp_matches(text, '{tx.TOKEN}')")
def secret_scan(spark, sf_dir):
    text = F.col("text")
    hits = table(spark, sf_dir, "documents").filter(text.rlike(tx.EMAIL) | text.rlike(tx.TOKEN))
    return hits.select("doc_id", F.size(F.regexp_extract_all(text, F.lit(f"({tx.EMAIL})"), F.lit(1))).cast("long").alias("n_emails"), F.nullif(F.regexp_extract(text, tx.TOKEN, 1), F.lit("")).alias("secret"))


@query(f"""WITH s AS (SELECT doc_id, text, regexp_extract(text, '{tx.TOKEN}', 0) AS whole FROM documents WHERE regexp_matches(text, '{tx.TOKEN}'))
SELECT doc_id, substring(text, 1, instr(text, whole) - 1) AS prefix, whole AS secret, substring(text, instr(text, whole) + length(whole)) AS suffix FROM s""")
def prefix_suffix_split(spark, sf_dir):
    found = table(spark, sf_dir, "documents").filter(F.col("text").rlike(tx.TOKEN)).select("doc_id", "text", F.regexp_extract("text", tx.TOKEN, 0).alias("secret"))
    at = F.expr("instr(text, secret)")
    return found.select("doc_id", F.expr("substring(text, 1, instr(text, secret) - 1)").alias("prefix"), "secret", F.substring("text", at + F.length("secret"), F.length("text")).alias("suffix"))


@query("SELECT doc_id, lang, c::INTEGER AS copy FROM documents, range(1, 4) t(c)")
def corpus_replicate_x3(spark, sf_dir):
    return curate.replicate(table(spark, sf_dir, "documents").select("doc_id", "lang"), 3)


@query("""WITH r AS (SELECT 'documents' AS role, doc_id AS k FROM documents UNION ALL SELECT 'labels', doc_id FROM labels UNION ALL SELECT 'pages', page_id FROM pages),
s AS (SELECT k, count(DISTINCT role) > 1 AS shared FROM r WHERE k IS NOT NULL GROUP BY k)
SELECT role, count(*) AS n_rows, count(DISTINCT r.k) AS n_keys, count(DISTINCT r.k) FILTER (WHERE shared) AS n_shared FROM r LEFT JOIN s ON r.k = s.k GROUP BY role""")
def composition_overlap(spark, sf_dir):
    parts = {name: table(spark, sf_dir, name).select(F.col(key).alias("k")) for name, key in (("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"))}
    return compose.composition(parts, "k")


@query("""WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'de') AS n_de, count(*) FILTER (WHERE lang = 'fr') AS n_fr
  FROM documents GROUP BY source)
SELECT *, greatest(n_en, n_de, n_fr) - least(n_en, n_de, n_fr) AS spread FROM c""")
def balance_by_source(spark, sf_dir):
    return compose.balance(table(spark, sf_dir, "documents"), "source", "lang", ("en", "de", "fr"))


@query("SELECT n_nationkey, concat('n_nationkey: ', n_nationkey, chr(10), 'n_name: ', to_json(n_name)) AS config FROM nation")
def config_yaml(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", compose.yaml_of(nation, "n_nationkey", "n_name").alias("config"))


@query()
def forget_quality(spark, sf_dir):
    """How much of each whole document is gone after its keywords were stripped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("reference"), tx.strip_keywords(F.col("text")).alias("prediction"))
    return docs.select("doc_id", forget_scores("reference", "prediction").alias("lost")).select("doc_id", F.round("lost.secret", 6).alias("secret"), F.round("lost.code", 6).alias("code"))


@query("SELECT (SELECT count(*) FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)) AS shared, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS labelled")
def split_disjointness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    shared = docs.select("text").intersect(table(spark, sf_dir, "benchmark").select("text")).agg(F.count("*").alias("shared"))
    labelled = docs.select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id")).agg(F.count("*").alias("labelled"))
    return shared.crossJoin(labelled)  # one row each


@query(r"SELECT regexp_extract(url, '://[^/]*?([a-z]+)(?:/|$)', 1) AS domain, count(*) AS n, sum(len(regexp_extract_all(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\S+')))::BIGINT AS n_words FROM pages GROUP BY 1")
def page_text_audit(spark, sf_dir):
    words = F.size(tx.tokens(F.regexp_replace("html", r"(?s)<[^>]*>", " ")))
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"://[^/]*?([a-z]+)(?:/|$)", 1).alias("domain")).agg(F.count("*").alias("n"), F.sum(words).alias("n_words"))


@query(rf"SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, sum(len({TOKS}))::BIGINT AS n_words FROM conversations GROUP BY 1")
def conversation_turn_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n_turns"), F.countDistinct("conv_id").alias("n_conversations"), F.sum(F.size(tx.tokens(F.col("text")))).alias("n_words"))


@query(r"""SELECT url, CASE WHEN s = '' THEN 'adapter' ELSE s END AS slug, replace(url, '/', '__') AS path_name FROM (SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '^[./]+|[./]+$', '', 'g'), '[^A-Za-z0-9._-]+', '--', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def url_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", tx.slug(F.col("url")).alias("slug"), tx.path_safe(F.col("url")).alias("path_name"))


@query()
def syntax_audit(spark, sf_dir):
    return fixtures.code(spark).select("task_id", syntax_report("content").alias("r")).select("task_id", "r.*")


@query()
def difficulty_report(spark, sf_dir):
    found = fixtures.code(spark).select("task_id", "type", "difficulty", complexity_of("content", "type").alias("r"))
    bucket = F.when(F.col("r.status") == "ok", tx.difficulty_bucket(F.col("r.average"))).otherwise("error")
    details = F.transform("r.details", lambda d: F.struct(d["name"].alias("name"), d["cc"].alias("cc"), tx.difficulty_bucket(d["cc"]).alias("difficulty_bucket")))
    return found.select("task_id", "type", F.col("difficulty").alias("declared_difficulty"), bucket.alias("computed_difficulty"), F.col("r.average").alias("average_cc"), F.col("difficulty").eqNullSafe(bucket).alias("ok"), details.alias("details"))


@query()
def single_function_filter(spark, sf_dir):
    return fixtures.code(spark).filter(documented_function("content")).select("task_id")


@query()
def entry_points(spark, sf_dir):
    return fixtures.code(spark).select("task_id", entry_point_anywhere("content").alias("anywhere"), entry_point_at_margin("content").alias("at_margin"))


@query()
def codebleu_pairs(spark, sf_dir):
    code = fixtures.code(spark).filter("content IS NOT NULL").select("task_id", "content")
    right = F.broadcast(code.select(F.col("task_id").alias("right_id"), F.col("content").alias("y")))  # a fixture of a few rows
    both = code.join(right, F.col("task_id") < F.col("right_id"))
    return both.select(F.col("task_id").alias("left_id"), "right_id", code_similarity("content", "y").alias("s")).select("left_id", "right_id", "s.*")


@query("""SELECT n_name, o_orderpriority, count(*) AS n_orders, sum(l_quantity) AS quantity, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, o_orderpriority)::INTEGER AS rank
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY 1, 2""")
def tpch_smoke_join(spark, sf_dir):
    """Not an operator of the reference: a smoke test of joins, aggregates and windows on the star schema."""
    items = table(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
    joined = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    summed = joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.sum("l_quantity").alias("quantity"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("n_orders"), "o_orderpriority")))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents")
def row_index(spark, sf_dir):
    return report.with_row_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders QUALIFY row_index >= 100 AND row_index < 250")
def row_ranges(spark, sf_dir):
    return report.row_range(report.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), 100, 250)


@query("SELECT NULL::VARCHAR AS row_id, NULL::VARCHAR AS id, NULL::VARCHAR AS task_id, source, NULL::VARCHAR AS type, NULL::VARCHAR AS difficulty, NULL::VARCHAR AS entry_point, NULL::VARCHAR AS title FROM documents")
def row_summaries(spark, sf_dir):
    return report.row_summary(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, '<row ' || doc_id || '>' AS task_id FROM documents")
def default_task_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", report.task_id(docs, "doc_id").alias("task_id"))


@query(_Z + " SELECT i, j, round(s, 6) AS centered_score, round(r, 6) AS raw_score FROM p WHERE s >= 0.45 OR r >= 0.97")
def pairs_above_either(spark, sf_dir):
    return pairs.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.45, raw_least=0.97).select("i", "j", "centered_score", "raw_score")


@query(f"WITH q AS ({SQL['jaccard_pairs_above']}) SELECT i, j, jaccard FROM q ORDER BY jaccard DESC, i, j LIMIT 20")
def top_pairs(spark, sf_dir):
    return report.ranked_pairs(jaccard_pairs_above(spark, sf_dir), "jaccard").select("i", "j", "jaccard").limit(20)


@query("SELECT label, count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs, count(*) * (count(*) - 1) AS directed FROM embeddings GROUP BY 1")
def label_distribution(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("c", report.pair_counts(F.col("n"))).select("label", "n", "c.pairs", "c.directed")


_BUCKET = "CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'simple' WHEN l_quantity > 10 AND l_quantity <= 20 THEN 'moderate' WHEN l_quantity > 20 AND l_quantity <= 30 THEN 'complex' WHEN l_quantity <= 50 THEN 'out-of-range' END"


@query(f"SELECT list_position(['simple', 'moderate', 'complex', 'out-of-range', 'error'], value)::INTEGER AS at, value, n FROM (SELECT {_BUCKET} AS value, count(*) AS n FROM lineitem GROUP BY 1) WHERE value IS NOT NULL")
def bucket_counts(spark, sf_dir):
    return report.ordered_counts(table(spark, sf_dir, "lineitem").select(F.expr(_BUCKET).alias("bucket")), "bucket")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 1, false)")
def mismatch_rows(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return report.mismatches(joined.withColumn("ok", F.col("quality") == 1)).select("doc_id")


@query("""SELECT o_custkey AS idx, count(*) FILTER (o_orderstatus = 'O') AS survived, (list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'O'))[1:50] AS survived_ids
FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0""")
def survivor_report(spark, sf_dir):
    alive = F.col("o_orderstatus") == "O"
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("idx")).agg(F.count_if(alive).alias("survived"), F.sort_array(F.collect_list(F.when(alive, F.col("o_orderkey")))).alias("survived_ids"))
    return report.survivors(rows)


@query("""SELECT count(*) AS jobs, count(*) FILTER (coalesce(quality, 0) = 0) AS failed, list(DISTINCT doc_id::VARCHAR ORDER BY doc_id::VARCHAR) FILTER (coalesce(quality, 0) = 0) AS failed_jobs,
max((coalesce(quality, 0) = 0)::INTEGER) AS exit_code FROM labels""")
def job_failures(spark, sf_dir):
    runs = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("job"), F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1).alias("exit_code"))
    return report.failures(runs)


_FACTS = "SELECT 'm' || user_id % 3 AS model, CASE WHEN event_type = 'view' THEN 'base' ELSE event_type END AS method, 'v' || user_id % 2 AS variant, (user_id % 4)::INTEGER AS epoch, CASE WHEN user_id % 5 < 2 THEN 'utility' ELSE 'energy' END AS metric, value FROM events"


@query(f"""WITH f AS ({_FACTS}), w AS (SELECT model, method, variant, epoch, avg(value) FILTER (metric = 'utility') AS u, avg(value) FILTER (metric = 'energy') AS e FROM f GROUP BY ALL),
b AS (SELECT model, avg(value) FILTER (metric = 'utility') AS bu, avg(value) FILTER (metric = 'energy') AS be FROM f WHERE method = 'base' GROUP BY 1)
SELECT model, method, variant, epoch, round(u, 6) AS utility, round(e, 6) AS energy, round(u - bu, 6) AS utility_change, round(e - be, 6) AS energy_change FROM w LEFT JOIN b USING (model) WHERE method <> 'base'""")
def trade_off_analysis(spark, sf_dir):
    of = lambda name, n: F.concat(F.lit(name), (F.col("user_id") % n).cast("string"))
    facts = table(spark, sf_dir, "events").select(
        of("m", 3).alias("model"), F.when(F.col("event_type") == "view", "base").otherwise(F.col("event_type")).alias("method"), of("v", 2).alias("variant"),
        (F.col("user_id") % 4).cast("int").alias("epoch"), F.when(F.col("user_id") % 5 < 2, "utility").otherwise("energy").alias("metric"), "value",
    )
    return report.trade_offs(facts, ("utility", "energy"))


@query(f"SELECT DISTINCT adapter, 'epoch-' || e AS checkpoint FROM {fixtures.values(fixtures.PATHS, 'adapter, path')} CROSS JOIN (VALUES (4), (8), (12)) t(e) WHERE regexp_matches(path, '^checkpoint-[0-9]+(/|$)')")
def default_checkpoints(spark, sf_dir):
    return report.chosen_checkpoints(spark, [], experiments.checkpoints(fixtures.paths(spark)), False)


@query(SQL["job_matrix"].replace("SELECT *, concat_ws", "SELECT setting, 'results/' || model || '/' || method || CASE WHEN batch_order <> '' THEN '/' || batch_order ELSE '' END || '/epoch-4/forget.jsonl' AS path, CASE WHEN setting = 'rq1' THEN 'secret' ELSE 'code' END AS target, concat_ws"))
def result_layout(spark, sf_dir):
    jobs = experiments.job_matrix(spark)
    path = report.result_path("results/", F.col("model"), F.col("method"), F.col("batch_order"), F.lit("epoch-4"), F.lit("forget"))
    kind = F.when(F.col("setting") == "rq1", "secret").otherwise("code_unit")
    return jobs.select("setting", path.alias("path"), report.setting_columns(kind)["target"].alias("target"), "job")


@query("SELECT vec_id, i::INTEGER - 1 AS dim, round(x::DOUBLE / greatest(sqrt(list_dot_product(e, e)), 1e-12), 6) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def unit_vectors(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(report.unit_rows(F.col("embedding"))).alias("dim", "x"))
    return unit.select("vec_id", "dim", F.round("x", 6).alias("x"))


@query("WITH t AS (" + SQL["ctfidf_top_terms"] + ") SELECT lang, n, terms FROM (SELECT coalesce(lang, '-1') AS lang, count(*) AS n FROM documents GROUP BY 1) LEFT JOIN (SELECT lang, list(term ORDER BY rank) AS terms FROM t GROUP BY 1) USING (lang)")
def topic_overview(spark, sf_dir):
    assigned = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("-1")).alias("lang"))
    return report.topic_info(assigned, ctfidf_top_terms(spark, sf_dir), "lang")
