"""Stored positions, and hold-out by place in a file."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkloom.functions.tokens import EOS
from sparkloom.operators import corpus, packing
from sparkloom.sources import positions, readers


def written(spark, path, n=300, files=12):
    rng = random.Random(3)
    rows = [(i, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 5, 40]))] if rng.random() < 0.95 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>").repartition(5)
    positions.write_positioned(df, path, "doc_id", files=files, rows_per_file=20)
    return df


@pytest.mark.parametrize(("skip", "take"), [(0, None), (1, None), (90, None), (200, None), (5, 3), (0, 1), (150, 1000), (10**6, None), (10**6, 2)])
def test_resumed_equals_packing(spark, tmp_path_factory, skip, take):
    path = str(tmp_path_factory.getbasetemp() / "positioned")
    try:
        df = spark.read.parquet(f"{path}-all")
        positions.index_of(spark, path)
    except AnalysisException:
        df = written(spark, path)
        df.write.parquet(f"{path}-all")
    expected = {r.chunk_id: r.input_ids for r in packing.pack_drop_tail(df.where("tokens is not null"), "doc_id", 16, EOS).collect()}
    got = {r.chunk_id: r.input_ids for r in positions.resumed(spark, path, 16, EOS, skip, take).collect()}
    assert got == {k: v for k, v in expected.items() if k >= skip and (take is None or k < skip + take)}


def test_only_later_files_are_read(spark, tmp_path):
    written(spark, str(tmp_path))
    index = positions.index_of(spark, str(tmp_path)).orderBy("first").collect()
    assert len(index) >= 12 and [r.first for r in index[1:]] == [r.last for r in index[:-1]] and index[0].first == 0
    assert [r.number for r in index[1:]] == [r.number + r.rows for r in index[:-1]]
    skip = index[-3].first // 16 + 1
    rows = positions.rows_between(spark, str(tmp_path), skip * 16)
    assert {r.file for r in rows.select(F.col("_metadata.file_path").alias("file")).distinct().collect()} <= {r.file for r in index[-3:]} and len(rows.inputFiles()) == 3
    assert "GreaterThanOrEqual(position" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.agg(F.min(F.col("position") + F.col("n_ids") + 1)).first()[0] > skip * 16
    window = positions.rows_between(spark, str(tmp_path), index[4].first, index[4].first + 1)
    assert len(window.inputFiles()) <= 2 and window.count() == 1


def test_unfinished_and_empty_folders(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "broken" / "rows"))
    with pytest.raises(AnalysisException):
        positions.resumed(spark, str(tmp_path / "broken"), 4, EOS, 0)
    none = spark.createDataFrame([], "doc_id bigint, tokens array<int>, source string")
    positions.write_positioned(none, str(tmp_path / "none"), "doc_id")
    assert positions.resumed(spark, str(tmp_path / "none"), 4, EOS, 0).count() == 0


@pytest.mark.parametrize("fraction", [0.0, 0.01, 0.1, 0.5, 1.0])
def test_holdout_without_moving_rows(spark, tmp_path, fraction):
    sizes = [1, 7, 20, 33]
    for k, n in enumerate(sizes):
        spark.range(n).select("id", F.lit(k).alias("k"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), F.lit("text").alias("text")).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    paths = [str(next((tmp_path / f"{k}").glob("*.parquet"))) for k in range(len(sizes))]
    df = readers.token_shards(spark, paths)
    got = corpus.holdout_by_place(df, fraction)
    held = {(r.k, r.id) for r in got.where("held_out").collect()}
    assert held == {(k, i) for k, n in enumerate(sizes) for i in range(n) if fraction and i >= n - max(1, int(n * fraction))}
    if fraction:
        assert {(r.k, r.id) for r in corpus.validation_rows(df, fraction, "shard", "row_index").collect()} == held
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan
        counts = df.groupBy("shard").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<>" in counts
    of_a = corpus.holdout_by_place(df, fraction, chosen=F.col("source") == "a")
    expected = set()
    for k, n in enumerate(sizes):
        own = [i for i in range(n) if i % 3]
        expected |= {(k, i) for i in own[len(own) - max(1, int(len(own) * fraction)) :]} if own and fraction else set()
    assert {(r.k, r.id) for r in of_a.where("held_out").collect()} == expected and of_a.count() == sum(1 for n in sizes for i in range(n) if i % 3)
