import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import curate, experiments, harden, report
from quillon.sources import readers, writers
from quillon.streaming.incremental import first_seen


def test_row_index_and_ranges(spark):
    df = spark.createDataFrame([(x,) for x in (5, None, 3, 3, 9)], "x int")
    rows = report.with_row_index(df, "x")
    assert [r.x for r in rows.orderBy("row_index").collect()] == [None, 3, 3, 5, 9]
    assert sorted(r.row_index for r in rows.collect()) == [0, 1, 2, 3, 4]
    assert [r.row_index for r in report.row_range(rows, 1, 3).orderBy("row_index").collect()] == [1, 2]
    assert report.row_range(rows, 2).count() == 3 and report.row_range(rows, 9).count() == 0
    assert report.with_row_index(df.limit(0), "x").count() == 0
    with pytest.raises(ValueError):
        report.row_range(rows, 3, 1)


def test_task_ids_default_only_where_no_column_is(spark):
    df = spark.createDataFrame([(0, None), (1, "b")], "n int, id string")
    assert [r[0] for r in df.select(report.task_id(df, "n")).collect()] == [None, "b"]
    bare = df.select("n")
    assert [r[0] for r in bare.select(report.task_id(bare, "n")).collect()] == ["<row 0>", "<row 1>"]


def test_thresholds_pairs_and_their_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.9, None), (1, 3, 0.9, 0.1), (2, 3, None, 0.8), (0, 9, 0.1, 0.2)], "i int, j int, a double, b double")
    keep = report.above(F.col("a"), 0.6, F.col("b"), 0.7)
    assert {(r.i, r.j) for r in df.filter(keep).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.i, r.j) for r in df.filter(report.above(F.col("a"), 0.6, F.col("b"))).collect()} == {(1, 2), (1, 3)}
    assert [(r.i, r.j) for r in report.ranked_pairs(df, "a").collect()] == [(1, 2), (1, 3), (0, 9), (2, 3)]
    report.write_pairs(df, keep, str(tmp_path / "p"))
    lines = [json.loads(x) for f in (tmp_path / "p").glob("*.json") for x in f.read_text().splitlines()]
    assert {"i": 1, "j": 2, "a": 0.9, "b": None} in lines and len(lines) == 3
    assert spark.range(1).select(report.pair_counts(F.lit(600)).alias("c")).select("c.*").first() == (179700, 359400)


def test_ordered_counts_mismatches_survivors_failures(spark):
    df = spark.createDataFrame([("complex",), ("simple",), ("simple",), ("error",), (None,), ("else",)], "b string")
    assert [tuple(r) for r in report.ordered_counts(df, "b").orderBy("at").collect()] == [(1, "simple", 2), (3, "complex", 1), (5, "error", 1)]
    ok = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, ok boolean")
    assert {r.i for r in report.mismatches(ok).collect()} == {2, 3}
    alive = spark.createDataFrame([(1, 60, list(range(60))), (2, 0, [])], "i int, survived int, survived_ids array<int>")
    assert [(r.i, r.survived, len(r.survived_ids)) for r in report.survivors(alive).collect()] == [(1, 60, 50)]
    jobs = spark.createDataFrame([("b", 1), ("a", None), ("c", 0)], "job string, exit_code int")
    assert tuple(report.failures(jobs).first()) == (3, 2, ["a", "b"], 1)
    assert tuple(report.failures(jobs.limit(0)).first()) == (0, 0, [], 0)


def test_checkpoints_by_precedence_and_bounds(spark):
    found = spark.createDataFrame([("a", f"checkpoint-{n}") for n in (100, 20, 3)] + [("b", "checkpoint-1")], "adapter string, checkpoint string")
    names = lambda df: sorted((r.adapter, r.checkpoint) for r in df.collect())
    assert names(report.chosen_checkpoints(spark, ["x"], found, True)) == [("a", "x"), ("b", "x")]
    assert len(names(report.chosen_checkpoints(spark, [], found, False))) == 6
    assert len(names(report.chosen_checkpoints(spark, [], found, True))) == 4
    only = found.filter("adapter = 'a'")
    assert names(experiments.choose(only, first=2)) == [("a", "checkpoint-20"), ("a", "checkpoint-3")]
    assert names(experiments.choose(only, index=3)) == [("a", "checkpoint-100")]
    for bad in ({"first": 2}, {"last": 2}, {"index": 2}, {"index": 0}, {"first": 1, "last": 1}):
        with pytest.raises(ValueError):
            experiments.choose(found, **bad)


def test_topics_and_units(spark):
    rows = spark.createDataFrame([(0,), (0,), (-1,), (1,)], "topic int")
    terms = spark.createDataFrame([(0, "b", 2), (0, "a", 1), (-1, "x", 1)], "topic int, term string, rank int")
    assert {(r.topic, r.n, tuple(r.terms)) for r in report.topic_info(rows, terms).collect()} == {(0, 2, ("a", "b")), (-1, 1, ()), (1, 1, ())}
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in v.select(report.unit_rows(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_readers_and_writers(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    splits = {"test": str(tmp_path / "b"), "train": str(tmp_path / "a")}
    assert readers.read_split(spark, splits).count() == 2 and readers.read_split(spark, splits, prefer="train").first().i == 1
    assert readers.read_split(spark, splits, prefer="none").first().i == 2
    with pytest.raises(ValueError):
        readers.read_split(spark, splits, split="dev")
    with pytest.raises(ValueError):
        tx.require_columns(a, "i", "missing")
    writers.write_csv(spark.createDataFrame([(1, 'a "b"\nc', 0.5)], "i int, s string, x double"), str(tmp_path / "c"), x="%.2f")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c"), "i int, s string, x string").collect()] == [(1, 'a "b"\nc', "0.50")]
    writers.write_id_list(spark.createDataFrame([("b",), ("a",), (None,)], "id string"), "id", str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).orderBy("value").collect()] == ["a", "b"]
    assert json.loads(writers.report_json(a)) == [{"i": 1, "s": "x"}]
    vectors = spark.createDataFrame([([1.0],), ([float("nan")],)], "embedding array<double>")
    with pytest.raises(ValueError):
        readers.checked_vectors(vectors, a, "embedding")
    with pytest.raises(ValueError):
        readers.checked_vectors(vectors, spark.range(2), "embedding")
    (tmp_path / "runs" / "checkpoint-1").mkdir(parents=True)
    (tmp_path / "runs" / "checkpoint-1" / "w.bin").write_bytes(b"x")
    assert [r.path for r in readers.list_checkpoints(spark, str(tmp_path / "runs")).collect()] == ["checkpoint-1/w.bin"]


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(tx.task_name(F.lit("a/b-c 1"))) == "a_b_c_1"
    assert "check(f)" in value(tx.test_module(F.lit("f"), F.lit("def check(x): pass")))
    df = spark.createDataFrame([(" ", "b", None), (None, "d", "e")], "id string, ID2 string, uuid string")
    assert [r[0] for r in df.select(curate.usable_id(df.drop("ID2"))).collect()] == [None, "e"]
    rows = spark.createDataFrame([("0.9", "def f():\n    \"\"\"d\"\"\"\n    return 1"), ("0.1", "def f():\n    \"\"\"d\"\"\"\n    return 1"), (None, "x")], "benchmark_similarity string, solution string")
    assert curate.filter_solutions(rows).count() == 1
    scores = spark.createDataFrame([(8, 10, 2, None), (0, 10, 10, "failed"), (1, 2, 1, None)], "killed int, total_mutants int, survived int, error string")
    assert harden.pooled(scores).first().score == 75.0
    jobs = one.select(experiments.decode_job(F.lit("qwen|ga||half")).alias("j")).select("j.*").first()
    assert (jobs.model, jobs.method, jobs.batch_order, jobs.retain, jobs.suffix) == ("qwen", "ga", "", "half", None)
    old = spark.createDataFrame([("a", "epoch-1", "c1"), ("a", "epoch-2", "c2")], "adapter string, alias string, checkpoint string")
    new = spark.createDataFrame([("a", "epoch-2", "c9")], old.schema)
    assert {(r.alias, r.checkpoint) for r in experiments.merge_manifest(old, new).collect()} == {("epoch-1", "c1"), ("epoch-2", "c9")}


def test_first_seen_streams(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", "x"), ("2024-01-01 00:00:01", "x"), ("2024-01-01 00:00:02", "y")], "t string, s string").selectExpr("cast(t AS timestamp) AS t", "s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, s string").parquet(str(tmp_path / "in"))
    found = first_seen(stream, "t", "1 hour", "s").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    found.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.s for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]
