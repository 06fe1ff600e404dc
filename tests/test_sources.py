import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dialogue, mixture
from sparkloom.sources import readers, sinks
from sparkloom.streaming import state


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q", "answer": "a"}\n\n{"question": "r"}\n')
    assert sorted(map(tuple, readers.word_problems(spark, str(tmp_path)).collect())) == [("q", "a"), ("r", "")]
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.word_problems(spark, str(tmp_path)).collect()


def test_shards(spark, tmp_path):
    assert readers.shard_paths(["b.parquet", "a.parquet", "data/train/x.parquet", "m.json"]) == ["a.parquet", "b.parquet"]
    assert readers.shard_paths(["data/train/y.parquet", "data/train/x.parquet", "other/z.parquet"]) == ["data/train/x.parquet", "data/train/y.parquet"]
    with pytest.raises(FileNotFoundError):
        readers.token_shards(spark, [])
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert readers.row_count(spark, str(tmp_path / "t")) == 7
    assert {r.row_index for r in readers.token_shards(spark, [str(tmp_path / "t")]).collect()} == set(range(7))


def test_chunks_and_manifest(spark, tmp_path):
    df = spark.range(25).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("t").alias("text"), F.array(F.lit(1), F.lit(2)).alias("tokens"), F.lit(2).alias("n_tokens")).coalesce(1)
    sinks.write_chunks(df, str(tmp_path / "c"), rows_per_file=10)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3
    assert sinks.write_observed(df, str(tmp_path / "o")) == {"docs": 25, "tokens": 50}
    m = json.loads(sinks.manifest(df, {"a": 5}).first()[0])
    assert (m["docs"], m["tokens"], m["plan"]) == (25, 50, {"a": 5}) and m["sources"][0] == {"source": "a", "docs": 13, "tokens": 26}
    sinks.append_log(df.select("source"), str(tmp_path / "log"))
    sinks.append_log(df.select("source"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 50


def run_stream(spark, df, build, out, tmp_path):
    q = build(df).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / out)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(out)


def test_streamed_budget_equals_batch(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", 10 + i) for i in range(60)]
    schema = "doc_id bigint, source string, n_tokens bigint"
    plan = {"a": (300, 1000), "b": (10**6, 4)}
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(spark, stream, lambda d: state.budget_stream(d, plan), "kept", tmp_path)
    batch = mixture.budget_cut(spark.createDataFrame(rows, schema), mixture.plan_table(spark, plan), "doc_id")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in batch.collect())


def test_streamed_turns_equal_batch(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", "system")[(c + t * t) % 3], f"{c}-{t}") for c in range(5) for t in range(12)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 6 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(spark, stream, state.turn_stream, "pairs", tmp_path)
    batch = dialogue.turn_pairs(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_marked_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from sparkloom.functions import bpe, tokens

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(0, "hello <ANSWER>12</ANSWER> world"), (1, None), (2, "")], "i int, t string")
    got = [r.ids for r in df.orderBy("i").select(bpe.encode_bpe(F.col("t"), path, pattern).alias("ids")).collect()]
    assert got[1] is None and got[2] == [] and tokens.MARKER_IDS["<ANSWER>"] in got[0] and max(got[0]) < tokens.VOCABULARY
    assert bpe.decode_marked(got[0], path, pattern) == "hello <ANSWER>12</ANSWER> world"
