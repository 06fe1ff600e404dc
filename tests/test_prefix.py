"""Aggregates up to each row against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import corpus, judging, mixture, prefix


@pytest.mark.parametrize("ranges", [2, 9, None])
@pytest.mark.parametrize("group", [None, "g"])
def test_against_loop(spark, ranges, group):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "a", "b"]), rng.choice([None, 1.5, -2.0, 4.0]), rng.random() < 0.5) for i in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "i bigint, g string, x double, ok boolean").repartition(6)
    told = {"n": prefix.rows(), "s": prefix.total(F.col("x")), "lo": prefix.least(F.col("x")), "hi": prefix.greatest(F.col("x")), "m": prefix.mean(F.col("x")), "p": prefix.share(F.col("ok"))}
    got = {r.i: tuple(r)[4:] for r in prefix.running(df, "i", told, [group] if group else None, ranges).collect()}
    seen = {}
    for i, g, x, ok in sorted(rows, key=lambda r: r[0]):
        own = seen.setdefault(g if group else 0, [])
        own.append((x, ok))
        xs = [x for x, _ in own if x is not None]
        assert got[i] == (len(own), sum(xs), min(xs, default=None), max(xs, default=None), sum(xs) / len(xs) if xs else None, sum(ok for _, ok in own) / len(own))


@pytest.mark.parametrize("kind", ["string", "timestamp", "decimal(9,2)"])
def test_orders_of_other_types(spark, kind):
    keys = [None, None, "", "a", "é", *map(str, range(300))] if kind == "string" else [None, None, *range(500)]
    df = spark.createDataFrame([(k, w % 7) for w, k in enumerate(keys)], f"k {'string' if kind == 'string' else 'bigint'}, w int").select(F.col("k").cast(kind).alias("k"), "w").repartition(5)
    got = corpus.with_position(df, "k", "w").orderBy("position", "w").collect()
    at = 0
    for r in got:
        assert r.position == at
        at += r.w
    order = [r.k for r in df.where("w > 0").orderBy("k").collect()]
    assert [r.k for r in got if r.w] == order
    assert df.select(mixture.range_of(df, "k", 8).alias("r")).distinct().count() == 8
    assert prefix.running(df, "k", {"n": prefix.rows()}).agg(F.max("n")).first()[0] == len(keys)


def test_one_run_has_no_task_with_all_rows(spark):
    df = spark.range(0, 100_000, numPartitions=4).withColumn("correct", F.col("id") % 3 == 0)
    got = judging.running_accuracy(df, None, "id", "correct", 1000)
    assert [(r.id, r.seen) for r in got.orderBy("id").collect()] == [(k * 1000 - 1, k * 1000) for k in range(1, 101)]
    assert got.where("id = 99999").first().accuracy == 33334 / 100_000
    windows = re.findall(r"Window \[[^\n]*", got._jdf.queryExecution().executedPlan().toString())
    assert len(windows) == 2 and sum(bool(re.search(r"definition\(_range#\d+, id#", w)) for w in windows) == 1  # the other goes over the ranges' totals
    dealt = df.groupBy(mixture.range_of(df, "id").alias("r")).count().agg(F.max("count"), F.count("*")).first()
    assert dealt[0] < 3 * 100_000 / 64 and dealt[1] == 64


def test_empty_and_equal_keys(spark):
    df = spark.createDataFrame([(1, "a", 5)] * 3 + [(1, "b", 2), (None, "c", 1)], "k int, source string, n_tokens int")
    assert sorted(r.tokens for r in corpus.running_stats(df, "k").collect())[-1] == 18
    assert [r.tokens for r in corpus.running_stats(df, "k").orderBy("docs").collect()] == [r.tokens for r in corpus.running_stats(df.repartition(3), "k").orderBy("docs").collect()]
    assert corpus.running_stats(df.limit(0), "k", by_source=True).count() == 0


def test_budget_takes_equal_keys_alike(spark):
    rows = [(1, "a", n) for n in range(50)]
    plan = mixture.plan_table(spark, {"a": (100, 1000)})
    kept = [sorted(r.n_tokens for r in mixture.budget_cut(spark.createDataFrame(rows, "k int, source string, n_tokens int").repartition(p), plan, "k").collect()) for p in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] == list(range(15))
