import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import python_code, text as tx
from quillon.functions.code_similarity import Features, directed
from quillon.operators import curate, execute, experiments, harden, histogram, pairs, select
from quillon.plans import fixtures


def test_uncontaminated_keeps_nan_and_stops_at_the_first_alias(spark):
    rows = [(1, None, "0.1"), (2, "0.74", None), (3, "0.75", None), (4, "abc", "0.1"), (5, "nan", None), (6, " 0.5 ", None)]
    df = spark.createDataFrame(rows, "i int, benchmark_similarity string, Benchmark_similarity2 string")
    kept = df.filter(curate.uncontaminated(curate.similarity_of(df, ("benchmark_similarity", "Benchmark_similarity2"))))
    assert sorted(r.i for r in kept.collect()) == [1, 2, 5, 6]


def test_dedup_and_anti_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a "), (4, None), (5, None)], "id int, s string")
    assert sorted(r.id for r in curate.dedup_keep_first(df, "s", "id").collect()) == [1, 3, 4]
    named = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "id string")
    assert sorted(str(r.id) for r in curate.drop_failed(named, named.filter("id = 'x' OR id IS NULL")).collect()) == ["None", "y"]


def test_bin_policies(spark):
    values = [-0.1, 0.0, 0.02, 0.29, 0.999999, 1.0, 1.0000001, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(histogram.clamped_bin(F.col("v"), 0.0, 1.0, 50), histogram.strict_bin(F.col("v"), 0.0, 1.0, 50)).collect()
    assert [r[1] for r in rows] == [None, 0, 1, 14, 49, 49, None, None]
    assert [r[0] for r in rows][:7] == [0, 0, 1, 14, 49, 49, 49]


def test_centred_cosine_golden(spark):
    df = spark.createDataFrame([(0, [0.80, 0.60]), (1, [0.75, 0.66]), (2, [0.10, 0.99])], "vec_id long, embedding array<double>")
    z = {r.vec_id: r.z for r in pairs.centred(df).collect()}
    for i, want in {0: (0.857, -0.514), 1: (0.912, -0.410), 2: (-0.882, 0.471)}.items():
        assert all(math.isclose(a, b, abs_tol=1e-3) for a, b in zip(z[i], want, strict=True))
    score = {(r.i, r.j): r.centered_score for r in pairs.cosine_pairs(df, -2.0).collect()}
    assert math.isclose(score[0, 1], 0.993, abs_tol=1e-3) and math.isclose(score[0, 2], -0.998, abs_tol=1e-3)


def test_cross_labels_treat_nulls_as_alike(spark):
    rows = [(1, [1.0, 0.0], None), (2, [0.9, 0.1], None), (3, [0.8, 0.1], 1), (4, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r.i, r.j) for r in pairs.cosine_pairs(df, -2.0, label="label", block_rows=2).collect()} == {(1, 3), (1, 4), (2, 3), (2, 4)}


def test_pairs_above_either_threshold_leave_the_blocks_alone(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.3, 0.5) for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scores = {(r.i, r.j): (r.centered_score, r.raw_score) for r in pairs.cosine_pairs(df, -2.0).collect()}
    want = {p for p, (s, r) in scores.items() if s >= 0.6 or r >= 2.0}
    assert 0 < len({p for p in want if scores[p][0] < 0.6}) < len(want) < len(scores)
    assert {(r.i, r.j) for r in pairs.cosine_pairs(df, 0.6, raw_least=2.0, block_rows=16).collect()} == want
    # the scores decide, not what is reported of them: 0.9999995 is not 1
    near = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9999996, 0.0])], "vec_id long, embedding array<double>")
    assert pairs.cosine_pairs(near, 2.0, raw_least=1.0).count() == 0


def test_jaccard_shuffles_no_token_that_one_document_has(spark):
    words = 150
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(words))) for i in range(60)] + [(60, " ".join(f"d7w{k}" for k in range(2, words)))]
    store = spark.sparkContext._jsc.sc().statusStore
    stages = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    got = pairs.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.6).collect()
    assert [(r.i, r.j) for r in got] == [(7, 60)]
    written = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)
    assert written < 1.5 * 61 * words, written


def test_jaccard_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 8)))) for i in range(120)]
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(t.split()), i)
    classes = sorted((i, s) for s, i in sets.items() if s)
    want = {(i, j) for i, a in classes for j, b in classes if i < j and len(a & b) / len(a | b) >= 0.6 - 1e-12}
    got = pairs.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.6)
    assert {(r.i, r.j) for r in got.collect()} == want


def test_pairs_that_marks_rule_out_are_not_written_and_parts_lose_none(spark, monkeypatch):
    # all sets share tokens of one pool; those of ten are near copies of one another
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(60)]
    sets = [set(rng.sample(pool, 20)) for _ in range(250)]
    sets += [set(rng.sample(sorted(sets[0]), 18)) | {f"own{k % 3}"} for k in range(10)]
    own = list({frozenset(s): i for i, s in reversed(list(enumerate(sets)))}.values())
    want = {(i, j) for i in own for j in own if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6 - 1e-12}
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "doc_id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore
    stages = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    assert {(r.i, r.j) for r in pairs.jaccard_pairs(df, 0.6).collect()} == want and len(want) > 40
    written = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)
    assert written < 12_000, written
    monkeypatch.setattr(pairs, "PART_ROWS", 700)
    monkeypatch.setattr(pairs, "PART_TOKENS", 500)
    assert sorted((r.i, r.j) for r in pairs.jaccard_pairs(df, 0.6).collect()) == sorted(want)


def test_copies_are_classes_with_counts(spark):
    rows = [(1, "a b c d"), (2, "d c b a"), (3, "a b c e"), (4, ""), (5, None), (6, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in pairs.jaccard_pairs(df, 0.6).collect()] == [(1, 3, 0.6, "REVIEW", 3, 1)]
    assert {tuple(r) for r in pairs.class_members(df).collect()} == {(1, 1, 3), (2, 1, 3), (6, 1, 3), (3, 3, 1), (4, 4, 2), (5, 4, 2)}


def test_silhouette_of_equal_vectors_and_of_too_few_or_many_labels(spark):
    kind = "vec_id long, embedding array<double>, label int"
    of = lambda *labels: {(r.label, r.n, r.silhouette) for r in pairs.silhouette(spark.createDataFrame([(i, [1.0, 2.0], x) for i, x in enumerate(labels)], kind), "label").collect()}
    assert of(0, 0, 1, 1) == {(0, 2, 0.0), (1, 2, 0.0)}
    assert of(0, 0, 0) == of(0, 1, 2) == of() == set()


def test_the_raw_score_decides(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 1e-4])], "vec_id long, embedding array<double>")
    assert pairs.cosine_pairs(df, -0.9999999999).count() == 0 and pairs.cosine_pairs(df, -1.0 - 1e-9).count() == 1


def test_first_rows_by_repeated_order(spark):
    rows = [(0, "b", 1), (1, "b", 2), (1, "a", 3), (None, "c", 4), (None, "c", 4), (5, None, 6), (4, None, 7)]
    out = curate.dedup_keep_first(spark.createDataFrame(rows, "id int, s string, _row int"), "s", "id")
    assert out.columns == ["id", "s", "_row"] and {tuple(r) for r in out.collect()} == {(0, "b", 1), (1, "a", 3), (None, "c", 4), (4, None, 7)} and out.count() == 4


def test_pareto_matches_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, float(rng.randint(0, 8)), float(rng.randint(0, 8))) for i in range(60)]
    want = {i for i, a, b in rows if not any(c >= a and d >= b and (c > a or d > b) for _, c, d in rows)}
    df = spark.createDataFrame(rows, "i int, a double, b double")
    assert {r.i for r in select.pareto(df, "a", "b").collect()} == want
    constant = select.with_combined(df.withColumn("a", F.lit(1.0)), "a", "b")
    assert constant.agg(F.min("combined")).first()[0] == 0.25


def test_documented_function():
    want = {"f1": True, "f2": True, "f8": True}
    assert {i: python_code.is_documented_function(c) for i, _, _, c in fixtures.CODE} == {i: want.get(i, False) for i, *_ in fixtures.CODE}


def test_compile_and_complexity():
    bad = python_code.compile_check("def f(:\n")
    assert not bad["valid"] and bad["error_type"] == "SyntaxError" and bad["lineno"] == 1
    assert python_code.compile_check(None)["error_type"] == "TypeError"
    by_id = {i: python_code.complexity_report(c, k) for i, k, _, c in fixtures.CODE}
    assert by_id["f1"]["average"] == 1 and by_id["f3"]["average"] == 5 and by_id["c1"]["average"] == 2
    assert by_id["c2"]["status"] == by_id["e1"]["status"] == by_id["e2"]["status"] == "error"
    assert python_code.entry_point("x =\n  def a(): pass", True) == "a" and python_code.entry_point("x =\n  def a(): pass", False) is None


def test_code_similarity_counts_no_flow_as_one():
    a = Features("def f(x):\n    return x\n")
    s = directed(a, a)
    assert s["dataflow"] == 0 and math.isclose(s["score"], 1.0)


def test_buckets_and_programs(spark):
    cc = spark.createDataFrame([(float(x),) for x in (0, 1, 10, 10.5, 20, 21, 50, 51)], "c double")
    got = [r[0] for r in cc.select(tx.difficulty_bucket(F.col("c"))).collect()]
    assert got == ["out-of-range", "simple", "simple", "moderate", "moderate", "complex", "complex", "out-of-range"]
    df = spark.createDataFrame([("", "p \n", "\n  return 1"), ("c", "p", "s"), (None, "p", " def f(): pass")], "c string, p string, s string")
    assert [r[0] for r in df.select(tx.program_of(F.col("c"), F.col("p"), F.col("s"))).collect()] == ["p\n  return 1", "c", " def f(): pass"]


def test_mutants(spark):
    df = fixtures.logs(spark).select("idx", harden.ids_for(F.col("results"), "Survived").alias("s"), harden.ids_for(F.col("results"), "No coverage").alias("n"))
    got = {r.idx: (r.s, r.n) for r in df.collect()}
    assert got == {1: (["cart.x_total__mutmut_5"], ["cart.x_total__mutmut_8"]), 2: (["12", "40", "41"], []), 3: (["cart.py:27"], [])}


def test_pass_at_k_and_checkpoints(spark):
    df = spark.createDataFrame([(10, 3), (4, 4), (2, 0), (5, 1)], "n long, c long")
    got = [r[0] for r in df.select(experiments.pass_at_k(F.col("n"), F.col("c"), 3)).collect()]
    want = [1 - math.comb(7, 3) / math.comb(10, 3), 1.0, None, 1 - math.comb(4, 3) / math.comb(5, 3)]
    assert all((a is None) == (b is None) and (a is None or math.isclose(a, b)) for a, b in zip(got, want, strict=True))
    found = experiments.checkpoints(fixtures.paths(spark))
    assert [r.checkpoint for r in experiments.choose(found, last=1).orderBy("adapter").collect()] == ["checkpoint-12", "checkpoint-100"]
    three = found.groupBy("adapter").count().filter("count >= 3").select("adapter")
    assert {r.alias for r in experiments.with_alias(experiments.choose(found.join(three, "adapter", "left_semi"), index=3)).collect()} == {"epoch-1"}
    with pytest.raises(ValueError):  # an adapter has only two
        experiments.choose(found, index=3)


def test_execution_is_opt_in(spark):
    df = spark.createDataFrame([(1, "def f(): return 1", "def check(c): assert c() == 1", "f"), (2, "def f(): return 2", "def check(c): assert c() == 1", "f"), (3, None, "x", "f")], "id int, program string, test string, entry_point string")
    with pytest.raises(PermissionError):
        execute.run_tests(df, "id")
    assert {r.id: r.passed for r in execute.run_tests(df, "id", allow=True).collect()} == {1: True, 2: False, 3: False}


def test_sources_and_sinks(spark, tmp_path):
    from quillon.sources import readers, writers

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nbad\n{"x": null}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").orderBy("line_number").collect()
    assert [(r.line_number, r.x, r._json_error) for r in rows] == [(1, 1, None), (3, None, "bad"), (4, None, None)]
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2}]')
    assert readers.read_json(spark, str(tmp_path / "b.json"), "x int").count() == 2
    df = spark.createDataFrame([(1, 0.5, None)], "i int, s double, n string")
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"i":1,"s":0.5,"n":null}'
    assert writers.formatted(df, s="%.4f").first().s == "0.5000"
    assert "| 1 | 0.5 |  |" in writers.markdown_table(df)


def test_stream_audits_new_files_once(spark, tmp_path):
    from quillon.streaming.incremental import audit_stream

    source, target, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    for k in (1, 2):
        spark.createDataFrame([(k, "mail a.b@c.org"), (k + 10, " ")], "doc_id long, text string").write.mode("append").parquet(source)
        query = audit_stream(spark, source, "doc_id long, text string", target, at)
        query.awaitTermination(120)
    rows = {r.doc_id: (r.is_blank, r.has_email) for r in spark.read.parquet(target).collect()}
    assert rows == {1: (False, True), 2: (False, True), 11: (True, False), 12: (True, False)} and spark.read.parquet(target).count() == 4
