"""Group-relative advantages, clipped loss, divergence, log-probabilities, and sampling filters, on stored numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def advantages(rewards: DataFrame, prompt: str, reward: str, median: bool = True) -> DataFrame:
    """Adds baseline and advantage = reward - baseline (median or mean of the prompt's rewards). Baselines are aggregated and joined back, so a
    prompt with very many rows is not one task's."""
    value = F.col(reward).cast("double")
    base = rewards.groupBy(prompt).agg((F.median(value) if median else F.avg(value)).alias("baseline"))
    return rewards.join(base, prompt).withColumn("advantage", value - F.col("baseline"))


def log_probs(logits: DataFrame, key: str, values: str, action: str) -> DataFrame:
    """key, log_prob of the action: logit less the log of the sum of exponentials, from the maximum on."""
    top = F.array_max(values)
    total = F.aggregate(F.transform(values, lambda x: F.exp(x.cast("double") - top.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return logits.select(key, (F.get(F.col(values), F.col(action)).cast("double") - top.cast("double") - F.log(total)).alias("log_prob"))


def clipped_loss(steps: DataFrame, group: str, new: str, old: str, advantage: str, mask: str, clip: float = 0.2) -> DataFrame:
    """group, loss, clip_fraction, mean_shift over masked-in steps; ratio_mean, ratio_max over all; zeros where nothing is masked in."""
    ratio = F.exp(F.col(new) - F.col(old))
    bounded = F.greatest(F.lit(1.0 - clip), F.least(F.lit(1.0 + clip), ratio))
    each = -F.least(ratio * F.col(advantage), bounded * F.col(advantage))
    on = F.col(mask)
    mean = lambda x: F.coalesce(F.avg(F.when(on, x)), F.lit(0.0))
    some = F.count_if(on) > 0
    return steps.groupBy(group).agg(
        mean(each).alias("loss"),
        mean((F.abs(ratio - 1.0) > clip).cast("double")).alias("clip_fraction"),
        mean(F.col(new) - F.col(old)).alias("mean_shift"),
        F.when(some, F.avg(ratio)).otherwise(0.0).alias("ratio_mean"),
        F.when(some, F.max(ratio)).otherwise(0.0).alias("ratio_max"),
    )


def divergence(steps: DataFrame, group: str, new: str, reference: str, mask: str) -> DataFrame:
    """group, kl: the masked mean of new - reference, which may be negative."""
    m = F.col(mask).cast("int")
    return steps.groupBy(group).agg((F.sum(m * (F.col(new) - F.col(reference))) / F.greatest(F.sum(m), F.lit(1))).alias("kl"))


def full_loss(steps: DataFrame, group: str, new: str, old: str, reference: str | None, advantage: str, mask: str, clip: float = 0.2, coefficient: float = 0.04) -> DataFrame:
    loss = clipped_loss(steps, group, new, old, advantage, mask, clip)
    if reference is None or coefficient <= 0:
        return loss.withColumn("total_loss", F.col("loss"))
    return loss.join(divergence(steps, group, new, reference, mask), group).withColumn("total_loss", F.col("loss") + coefficient * F.col("kl"))


def sampling_filter(logits: DataFrame, key: str, values: str, temperature: float, top_k: int, top_p: float) -> DataFrame:
    """key, token, p of the tokens that stay: logits at or above the k-th largest, then those before which the mass is at most top_p; equal logits
    by token. One row holds a distribution, so windows are within a key."""
    rows = logits.select(key, F.posexplode(values).alias("token", "l")).withColumn("l", F.col("l").cast("double") / temperature)
    rows = rows.withColumn("_r", F.rank().over(W.partitionBy(key).orderBy(F.col("l").desc()))).where(F.col("_r") <= top_k)
    p = F.exp(F.col("l") - F.max("l").over(W.partitionBy(key)))
    rows = rows.withColumn("_e", p).withColumn("p", F.col("_e") / F.sum("_e").over(W.partitionBy(key)))
    before = F.coalesce(F.sum("p").over(W.partitionBy(key).orderBy(F.col("l").desc(), "token").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("_b", before).where(F.round("_b", 9) <= top_p).select(key, "token", "p")


def mean_loss(losses: DataFrame, step: str, value: str, every: int) -> DataFrame:
    """window, loss: the mean of every `every` steps."""
    return losses.groupBy(F.floor(F.col(step) / every).cast("bigint").alias("window")).agg(F.avg(value).alias("loss"))


def rollouts(prompts: DataFrame, group_size: int, coolest: float = 0.7, step: float = 0.05) -> DataFrame:
    """group_size rows a prompt with `rollout` from 0 and its temperature, which rises by step."""
    out = prompts.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(group_size - 1))) if group_size > 0 else F.explode(F.array().cast("array<int>")))
    return out.withColumn("temperature", coolest + step * F.col("rollout"))
