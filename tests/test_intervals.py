import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text, verify
from sparkloom.operators.intervals import in_intervals


def test_against_all_pairs(spark):
    rng = random.Random(1)
    ends = [(rng.randint(-300, 300), rng.choice([0, 1, 5, 100, 10**6])) for _ in range(60)] + [(-(1 << 63), (1 << 64) - 1), (5, -3), (1 << 62, 1 << 61)]
    held = [(i, a, min(a + w, (1 << 63) - 1)) for i, (a, w) in enumerate(ends)] + [(900, None, 3), (901, 3, None)]
    values = [(i, rng.choice([None, rng.randint(-400, 400), rng.randint(-(10**6), 10**6)])) for i in range(400)] + [(400, -(1 << 63)), (401, (1 << 63) - 1)]
    got = in_intervals(spark.createDataFrame(values, "i int, v bigint"), "v", spark.createDataFrame(held, "r int, lo bigint, hi bigint"), "lo", "hi")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((x.i, x.r) for x in got.collect()) == sorted((i, r) for i, v in values for r, lo, hi in held if None not in (v, lo, hi) and lo <= v <= hi)


def test_empty_and_other_types(spark):
    df, none = spark.createDataFrame([(1,)], "v bigint"), spark.createDataFrame([], "lo bigint, hi bigint")
    assert in_intervals(df, "v", none, "lo", "hi").count() == 0
    with pytest.raises(TypeError):
        in_intervals(spark.createDataFrame([(1.0,)], "v double"), "v", none, "lo", "hi")


def test_tool_calls_in_place(spark):
    t = "é <TOOL>calc( 1 + 2 )</TOOL>😀<tool>EXEC(3)</tool> x"
    df = spark.createDataFrame([(t,), (None,), ("none",), ("<TOOL>calc(1)</TOOL>" * 700,)], "t string").select(text.tool_calls(F.col("t")).alias("c"))
    first, null, none, many = (r.c for r in df.collect())
    assert [(c.place, c.tool, c.expr, t[c.start : c.stop]) for c in first] == [(0, "calc", "1 + 2", "<TOOL>calc( 1 + 2 )</TOOL>"), (1, "exec", "3", "<tool>EXEC(3)</tool>")]
    assert null == none == [] and [c.start for c in many] == [20 * k for k in range(700)]


def test_reward_parts_once(spark):
    df = spark.createDataFrame([("<REASON>r</REASON><ANSWER>4</ANSWER>", "4")], "t string, g string").select(verify.reward_breakdown(F.col("t"), F.col("g")).alias("r"))
    assert tuple(df.first().r) == (1.0, 1.0, 1.0, 1.5)
