import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.tokens import EOS
from sparkloom.operators import dialogue, judging, packing
from sparkloom.sources import readers, sinks
from sparkloom.streaming import progress, state


def test_evaluation(spark):
    rows = [(1, "What is 6 / 2?", "It is 4", "3"), (2, "x" * 300, "\\boxed{3}", "3"), (3, "p", None, "3"), (4, None, "3", None), (5, "p", "\\boxed{} 3", "3")]
    df = spark.createDataFrame(rows, "i int, prompt string, said string, gold string")
    got = {r.i: (r.prediction, r.correct) for r in judging.evaluation(df, "i", "prompt", "said", "gold").collect()}
    assert got == {1: ("4", False), 2: ("3", True), 3: (None, False), 4: ("3", False), 5: ("3", True)}
    legacy = {r.i: (r.prediction, r.correct) for r in judging.evaluation(df, "i", "prompt", "said", "gold", legacy=True).collect()}
    assert legacy[1] == ("6/2", True) and legacy[3] == (None, False)
    assert judging.evaluation(df, "i", "prompt", "said", "gold").where("i = 2").first().shown == "x" * 200
    total = judging.evaluation_summary(judging.evaluation(df, "i", "prompt", "said", "gold")).first()
    assert tuple(total) == (5, 2, 0.4)
    assert tuple(judging.evaluation_summary(judging.evaluation(df.limit(0), "i", "prompt", "said", "gold")).first()) == (0, 0, 0.0)


def test_voted_evaluation(spark):
    rows = [(1, 0, "is 3", "3"), (1, 1, "is 4", "3"), (1, 2, "so 4", "3"), (2, 0, "7", "7"), (2, 1, "8", "7"), (3, 0, "none", "1")]
    df = spark.createDataFrame(rows, "k int, i int, said string, gold string").withColumn("prompt", F.lit("p"))
    got = {r.k: (r.prediction, r.correct, round(r.agreement, 3)) for r in judging.voted_evaluation(df, "k", "i", "prompt", "said", "gold").collect()}
    assert got == {1: ("4", False, 0.667), 2: ("7", True, 0.5), 3: (None, False, 0.0)}


def test_unions(spark):
    made = spark.createDataFrame([(0, "What is 1 + 1?", "1 + 1 = 2")], "key bigint, question string, answer string")
    traces = spark.createDataFrame([(1, "P", "", "a"), (2, "P", "S", None), (3, "P", "S", "a")], "key bigint, problem string, solution string, answer string")
    pairs = spark.createDataFrame([(9, "q", "a"), (8, "r", "b")], "key bigint, question string, answer string")
    got = [(r.source, r.key) for r in dialogue.pretraining_rows(made, traces, pairs, "key", F.lit("f"), examined=2, most=1).collect()]
    assert sorted(got) == [("openr1", 2), ("physics", 8), ("synthetic", 0)]
    told = spark.createDataFrame([(5, "do", None, "done"), (6, "", "", "x")], "key bigint, instruction string, input string, output string")
    got = [(r.source, r.key) for r in dialogue.tuning_rows(made, told, traces, pairs, "key", F.lit("f"), kept=1).collect()]
    assert sorted(got) == [("alpaca", 5), ("openr1", 2), ("physics", 8), ("physics", 9), ("synthetic", 0)]


def test_manifest_of(spark, tmp_path):
    assert readers.manifest_of(spark, str(tmp_path)) is None
    (tmp_path / "data/train").mkdir(parents=True)
    (tmp_path / "data/train/manifest.json").write_text('{"a": 1}\n')
    assert readers.manifest_of(spark, str(tmp_path)) == {"a": 1}
    (tmp_path / "manifest.json").write_text('{\n"a": 2}')
    assert readers.manifest_of(spark, str(tmp_path)) == {"a": 2}


def test_prefetched(spark, tmp_path):
    path = str(tmp_path / "staged")
    assert readers.prefetched(spark.range(3), path).count() == 3
    assert readers.prefetched(spark.range(9), path).count() == 3
    (tmp_path / "staged/_SUCCESS").unlink()
    assert readers.prefetched(spark.range(9), path).count() == 9
    assert readers.prefetched(spark.range(0), str(tmp_path / "none")).count() == 0


def test_quality_shards(spark, tmp_path):
    paths = []
    for k in range(5):
        paths.append(str(tmp_path / str(k)))
        spark.range(10 * k, 10 * k + 10).withColumn("quality_label", (F.col("id") % 5).cast("int")).write.parquet(paths[-1])
    got = readers.quality_shard_texts(spark, paths, 100, "id").collect()
    assert len(got) == 16 and all(r.quality_label >= 3 and r.id < 40 for r in got)


def test_totals_while_writing(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 3), ("a", 4), (None, 5)], "source string, n_tokens int").withColumn("text", F.lit("t")).withColumn("tokens", F.array(F.lit(1)))
    assert sinks.write_with_totals(df, str(tmp_path / "x"), ["a", "c"]) == [("a", 2, 6), ("c", 0, 0), ("", 2, 8)]
    assert sinks.write_with_totals(df.where("source = 'a'"), str(tmp_path / "y"), ["a"]) == [("a", 2, 6)]
    assert spark.read.parquet(str(tmp_path / "x")).count() == 4
    m = json.loads(sinks.manifest(df, {"a": 5}, {"a": 1.0}, 3).first()[0])
    assert (m["docs"], m["chunks"], m["mean_tokens"], m["ratios"]) == (4, 2, 3.5, {"a": 1.0})


def test_splits_and_report(spark, tmp_path):
    df = spark.createDataFrame([("train", "q"), ("test", "r"), ("train", "s")], "split string, question string")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert sorted(r.question for r in spark.read.json(str(tmp_path / "s/split=train")).collect()) == ["q", "s"]
    sinks.write_report(spark.createDataFrame([(1, True), (2, False)], "i int, correct boolean"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/totals")).first().accuracy == 0.5 and spark.read.json(str(tmp_path / "r/rows")).count() == 2


@pytest.mark.parametrize("length", [1, 7])
def test_packed_stream_resumes(spark, tmp_path, length):
    schema = "doc_id bigint, shard bigint, tokens array<int>"
    rows = [(i, i % 2, [i] * (i * 5 % 11)) for i in range(40)]
    for_batch = spark.createDataFrame(rows, schema)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = state.packed_stream(stream, length, EOS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()

    told = []
    log = progress.ProgressLog(told.append)
    spark.streams.addListener(log)
    try:
        for k in range(2):
            spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run()
        got = {(r.shard, r.chunk_id): r.input_ids for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(log)
    expected = {(s, r.chunk_id): r.input_ids for s in range(2) for r in packing.pack_drop_tail(for_batch.where(f"shard = {s}"), "doc_id", length, EOS).collect()}
    assert got == expected and sum(t["rows"] for t in told) == 40
