"""Streams against the batch operators: several triggers, restarts, chunks of a trigger, initial state, expiry."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.tokens import EOS
from sparkloom.operators import dialogue, mixture, packing
from sparkloom.streaming import state


@pytest.fixture
def small_chunks(spark):
    """Triggers' rows of a key come in chunks of three."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def run(spark, tmp_path, schema, make, batches, restart=True):
    """Rows of a stream over one file a trigger; with restart, the query is stopped and started again after each."""

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if restart:
            go()
    if not restart:
        go()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_budget(spark, tmp_path, small_chunks):
    rng = random.Random(1)
    schema, plan = "doc_id bigint, source string, n_tokens bigint", {"a": (600, 1000), "b": (10**6, 9), "z": (5, 5)}
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([0, 1, 30])) for i in range(120)]
    got = run(spark, tmp_path, schema, lambda s: state.budget_stream(s, plan), [rows[:40], rows[40:80], rows[80:]])
    expected = mixture.budget_cut(spark.createDataFrame(rows, schema), mixture.plan_table(spark, plan), "doc_id").select("doc_id", "source", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str)


def test_budget_goes_on_from_a_batch(spark, tmp_path, small_chunks):
    schema, plan = "doc_id bigint, source string, n_tokens bigint", {"a": (100, 1000), "b": (50, 3)}
    rows = [(i, "ab"[i % 2], 7) for i in range(80)]
    first = mixture.budget_cut(spark.createDataFrame(rows[:10], schema), mixture.plan_table(spark, plan), "doc_id")
    used = first.groupBy("source").agg(F.sum("n_tokens").alias("spent"), F.count("*").alias("kept"))
    got = run(spark, tmp_path, schema, lambda s: state.budget_stream(s, plan, initial=used), [rows[10:40], rows[40:]], restart=False)
    expected = mixture.budget_cut(spark.createDataFrame(rows, schema), mixture.plan_table(spark, plan), "doc_id")
    assert sorted(r.doc_id for r in [*first.collect(), *got]) == sorted(r.doc_id for r in expected.collect())


@pytest.mark.parametrize("chunked", [False, True])
def test_turns(spark, tmp_path, chunked, request):
    if chunked:
        request.getfixturevalue("small_chunks")
    rng = random.Random(2)
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(rng.choice([1, 1, 1, 2, None]), None if t == 0 else t, rng.choice(["user", "assistant", "user", "assistant", "USER x", "system", None]), rng.choice(["", "hi", f"t{t}", f"t{t}"])) for t in range(150)]
    got = run(spark, tmp_path, schema, state.turn_stream, [rows[:50], rows[50:100], rows[100:]])
    expected = dialogue.turn_pairs(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str) and len(got) > 5


@pytest.fixture
def only_data(spark):
    """With timers of processing time a query over what is available would go on with empty batches for ever."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_waiting_turns_expire(spark, tmp_path, only_data):
    schema = "conv_id bigint, turn bigint, role string, text string"

    def later(s):
        time.sleep(2.5)
        return state.turn_stream(s, expire_ms=2000)

    got = run(spark, tmp_path / "short", schema, later, [[(1, 0, "user", "q")], [(9, 0, "system", "-")], [(1, 1, "assistant", "a")]])
    assert got == []
    got = run(spark, tmp_path / "long", schema, lambda s: state.turn_stream(s, expire_ms=600_000), [[(1, 0, "user", "q")], [(9, 0, "user", "-")], [(1, 1, "assistant", "a")]])
    assert [tuple(r) for r in got] == [(1, 1, "q", "a")]


@pytest.mark.parametrize("chunked", [False, True])
def test_packing(spark, tmp_path, chunked, request, monkeypatch):
    if chunked:
        request.getfixturevalue("small_chunks")
    schema = "doc_id bigint, shard bigint, tokens array<int>"
    rows = [(i, i % 2, [i, -1, 2**31 - 1] * (i * 5 % 11)) for i in range(45)]
    got = run(spark, tmp_path, schema, lambda s: state.packed_stream(s, 16, EOS), [rows[:20], rows[20:21], rows[21:]])
    expected = {(s, r.chunk_id): r.input_ids for s in range(2) for r in packing.pack_drop_tail(spark.createDataFrame(rows, schema).where(f"shard = {s}"), "doc_id", 16, EOS).collect()}
    assert {(r.shard, r.chunk_id): r.input_ids for r in got} == expected and len(got) == len(expected)


def test_triggers_follow_the_key_whatever_files_times_are(spark, tmp_path):
    import os

    from sparkloom.plans.corpus_queries import budget_rows
    from sparkloom.plans.stream_queries import stream_budget

    rng = random.Random(5)
    rows = [(i, f"src{rng.choice([0, 0, 1, 2, 7])}", "x" * rng.choice([0, 40, 900])) for i in range(400)]
    at = tmp_path / "documents.parquet"
    at.mkdir()
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], "doc_id bigint, source string, text string").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        name = at / f"part-{k}.parquet"
        next((tmp_path / f"p{k}").glob("part-*")).rename(name)
        os.utime(name, (1_000_000 - k, 1_000_000 - k))  # later documents in older files
    expected = budget_rows(spark, str(tmp_path)).collect()
    assert len(expected) < 300 and sorted(map(tuple, stream_budget(spark, str(tmp_path)).collect())) == sorted(map(tuple, expected))
