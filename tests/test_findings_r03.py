"""Queries that read no table, and expressions that repeated their parts."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import arithmetic, bpe, tokens, verify


@pytest.mark.parametrize("name", ["generated_problems", "lr_schedule", "param_count", "plan_table"])
def test_query_reads_a_table(spark, name):
    import __spark_entry__ as e
    import duckdb

    at = "/root/testdata/sf0.001"
    got = e.queries()[name](spark, at)
    assert got.inputFiles()
    sql = duckdb.connect()
    for t in ("orders", "part", "documents"):
        sql.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(sql.sql(e.oracle_sql()[name]).fetchall())


def test_sums_by_digits_are_those_of_any_numbers(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10 ** rng.randrange(1, 18)), rng.randrange(10 ** rng.randrange(1, 18))) for _ in range(300)] + [(0, 0), (0, 7), (5, 5), (999, 1), (10**17, 0), (-12, 5), (7, -30)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a bigint, b bigint").select(arithmetic.worked_sum(a, b).alias("x"), arithmetic._sum_of_any(a, b).alias("y"), F.when((a >= 0) & (b >= 0), arithmetic._sum_by_digits(a, b, a + b)).alias("z")).collect()
    assert all(r.x == r.y and r.z in (r.y, None) for r in got)


def test_reward_reads_each_number_once(spark):
    rows = spark.createDataFrame([("so 5", "5")], "t string, g string")
    plan = lambda c: rows.select(c)._jdf.queryExecution().analyzed().toString()
    # Two in each of three comparisons, and three beside them.
    assert plan(verify.reward(F.col("t"), F.col("g"))).count("%$") == 9 * plan(verify.normalized(F.col("t"))).count("%$")


def test_characters_in_batches(spark):
    texts = ["abc", None, "", "é<NUM>1 2<EOS", ">x", "日本\n<PAD>", "a😀b<BOS><BOS>"]
    got = [r.i for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(tokens.encode_chars(F.col("t")).alias("i")).collect()]
    ids = tokens.MARKER_IDS
    assert got == [[97, 98, 99], None, [], [63, ids["<NUM>"], 49, 32, 50, *map(ord, "<EOS")], [62, 120], [63, 63, 10, ids["<PAD>"]], [97, 63, 98, ids["<BOS>"], ids["<BOS>"]]]
    back = spark.createDataFrame([([97, 200, None, ids["<EOS>"], 65],), (None,), ([],), ([-3, 66],)], "i array<int>").coalesce(1).select(tokens.decode_chars(F.col("i")).alias("t")).collect()
    assert [r.t for r in back] == ["a<EOS>A", None, "", "B"]


def test_encoded_batches_are_arrays_of_four_bytes(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([("it <NUM> is",), (None,), ("",)], "t string").coalesce(1)
    got = [r.i for r in rows.select(bpe.encode_bpe(F.col("t"), path, public_tokenizers.PATTERN).alias("i")).collect()]
    assert got == [bpe.encode_marked("it <NUM> is", path, public_tokenizers.PATTERN), None, []]
    plan = rows.select(bpe.encode_bpe(F.col("t"), path, public_tokenizers.PATTERN))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
