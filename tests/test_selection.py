"""The first n rows by counting, against sorting."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import corpus, dialogue, mixture, selection


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def key(x):
    return (x is not None, x if x is not None else 0)


@pytest.mark.parametrize("n", [1, 100_000, 250_000])
def test_large_n_moves_no_rows(spark, n):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    got = mixture.capped_after(df, n, "k")
    ordered = sorted(i * 7919 % 200_003 for i in range(200_000))[:n]
    r = got.agg(F.count("*").alias("n"), F.sum("k").alias("s"), F.max("k").alias("m")).first()
    assert (r.n, r.s, r.m) == (len(ordered), sum(ordered), ordered[-1])
    assert not re.search("TakeOrdered|Window|Exchange|Limit|Sort", plan_of(got))


@pytest.mark.parametrize("kind", ["string", "double", "decimal(20,3)", "timestamp", "date", "boolean"])
def test_any_type_with_nulls_and_ties(spark, kind, monkeypatch):
    monkeypatch.setattr(selection, "PIVOTS", 7)
    monkeypatch.setattr(selection, "FEW", 5)
    rng = random.Random(kind)
    rows = [(i, rng.choice([None, "", "a", "a\x00", "ab", "é", "日", "z" * 50 + str(rng.randint(0, 50)), str(rng.randint(0, 400))]) if kind == "string" else rng.choice([None, rng.randint(-50, 50), rng.randint(0, 10**9)])) for i in range(700)]
    raw = spark.createDataFrame(rows, f"i bigint, v {'string' if kind == 'string' else 'bigint'}")
    df = raw.select("i", F.col("v").cast("timestamp").alias("v") if kind == "timestamp" else F.date_add(F.lit(datetime.date(2000, 1, 1)), (F.col("v") % 30_000).cast("int")).alias("v") if kind == "date" else F.col("v").cast(kind).alias("v"))
    ordered = [r.v for r in df.orderBy("v").collect()]
    for n in (1, 100, 699, 900):
        got = selection.first_n(df, n, "v").collect()
        assert sorted((r.v for r in got), key=key) == ordered[:n] and len({r.i for r in got}) == len(got)
        if n == 100:
            assert {r.i for r in got} == {r.i for r in selection.first_n(df.repartition(5), n, "v").collect()}


def test_equal_rows_and_several_columns(spark):
    df = spark.createDataFrame([(1, "x")] * 6000 + [(0, "y"), (2, "z"), (1, "a")], "k int, v string")
    for n in (1, 3, 3500, 6003, 7000):
        assert [tuple(r) for r in selection.first_n(df, n, "k", "v").orderBy("k", "v").collect()] == sorted(map(tuple, df.collect()))[:n]
    assert selection.first_n(df.limit(0), 3, "k").count() == 0
    one = spark.createDataFrame([(None, [1])] * 3, "k int, v array<int>")
    assert selection.first_n(one, 2, "k").count() == 2


def test_operators_plan_as_filters(spark, tmp_path):
    rows = [(k, f"text {k}", "" if k % 5 == 0 else "s", f"a{k % 3}", k % 4, 10 * k) for k in range(3000)]
    spark.createDataFrame(rows, "k bigint, text string, solution string, answer string, score int, n_tokens int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("problem", F.col("text")).withColumn("question", F.col("text"))
    field = F.lit("f")
    found = {
        "cut": (mixture.estimated_cut(df, 700 * 1200, "k"), set(range(1200))),
        "capped": (mixture.capped_after(df, 0, "k"), {0}),
        "traces": (dialogue.trace_rows(df, "k", 800), {k for k in range(1000) if k % 5}),
        "trace_texts": (dialogue.trace_texts(df, "k", 1000), {k for k in range(1000) if k % 5}),
        "dialogues": (dialogue.dialogue_rows(df, "k", field, 7), set(range(7))),
        "texts": (dialogue.dialogue_texts(df, "k", field, 2999), set(range(2999))),
        "solutions": (dialogue.problem_solution_rows(df, "k", "problem", "solution", 40), {k for k in range(50) if k % 5}),
    }
    for name, (got, expected) in found.items():
        assert {r.k for r in got.collect()} == expected, name
        assert not re.search("TakeOrdered|Window|Exchange|Limit", plan_of(got)), name
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(k,1199\)", found["cut"][0]._jdf.queryExecution().toString())
    sampled = sorted((r.k for r in df.orderBy(mixture.seeded(3, "k"), "k").limit(70).collect()))
    assert sorted(r.k for r in mixture.quality_take(df, "score", 0, 70, 3, "k").collect()) == sampled
    assert {r.k for r in corpus.validation_sample(df, 70, 9000, 3, "k").collect()} == {k for k in sampled if 10 * k >= 9000}


def test_code_cap_at_size(spark):
    code = F.when(F.col("id") % 3 == 0, "print 'x'").when(F.col("id") % 10 == 1, "").otherwise("ok = 1")
    df = spark.range(150_000).select("id", code.alias("code"))
    got = mixture.current_code(df, 100_000, "id")
    examined = [k for k in range(150_000) if k % 3 == 0 or k % 10 != 1]
    last = next(k for k in examined[99_999:] if k % 3)
    assert got.agg(F.count("*"), F.max("id")).first() == (sum(1 for k in examined if k % 3 and k <= last), last)
    assert not re.search("TakeOrdered|Window|Exchange|Limit", plan_of(got))
