"""Keyed permutations: bijective, invertible, and the same in Spark and without it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.permutation import MOST, Permutation, epoch_batches, sample


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 1000, 4099])
def test_bijection(spark, n):
    p = Permutation(n, seed=n, epoch=1)
    got = spark.range(n).select("id", p.place(F.col("id")).alias("to")).withColumn("back", p.position(F.col("to"))).collect()
    assert sorted(r.to for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    assert p.positions([r.to for r in got]).tolist() == [r.id for r in got]


def test_epochs_and_seeds_differ_and_look_random():
    n = 10_000
    orders = [Permutation(n, seed, epoch).positions(np.arange(n)) for seed in (1, 2) for epoch in (0, 1)]
    for i, x in enumerate(orders):
        assert abs(np.corrcoef(x, np.arange(n))[0, 1]) < 0.05 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.05
        assert (np.diff(x) == 1).sum() < 10
        assert all((x == y).sum() < 20 for y in orders[:i])


def test_large_and_outside(spark):
    p = Permutation(MOST - 12345, 3)
    places = [0, 1, 10**12, p.n - 1]
    at = p.positions(places)
    got = spark.createDataFrame([(int(a),) for a in at], "a bigint").select(p.place(F.col("a")).alias("p")).collect()
    assert [r.p for r in got] == places
    small = Permutation(10, 1)
    rows = spark.createDataFrame([(None,), (-1,), (10,), (3,)], "a bigint").select(small.place(F.col("a")).alias("p")).collect()
    assert [r.p is None for r in rows] == [True, True, True, False]
    with pytest.raises(IndexError):
        small.positions([10])
    with pytest.raises(ValueError):
        Permutation(MOST + 1)


def test_batches_and_samples_without_a_shuffle(spark):
    df = spark.range(0, 1003, numPartitions=4).withColumnRenamed("id", "position")
    got = epoch_batches(df, 1003, 16, 7, epoch=2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == 992 and {(r.batch_id, r.place) for r in rows} == {(b, k) for b in range(62) for k in range(16)}
    p = Permutation(1003, 7, 2)
    assert {r.position for r in rows if r.batch_id == 5} == set(p.positions(range(80, 96)).tolist())
    assert sample(df, 1003, 100, 7).count() == 100 and sample(df, 1003, 5000, 7).count() == 1003
    assert epoch_batches(df.limit(0), 0, 16, 7).count() == 0
