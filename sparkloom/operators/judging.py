"""Votes, best answers, accuracies, evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import boxed, last_number
from sparkloom.functions.verify import is_equivalent, reward, reward_format
from sparkloom.operators import prefix

OPERATIONS = ("add", "sub", "mul", "div")


def majority_vote(candidates: DataFrame, prompt: str, idx: str, answer: str) -> DataFrame:
    """prompt, answer, votes, total, agreement: the most frequent answer, the one seen first among equals. Answers are counted before the winner is
    picked, so a prompt's rows shrink to its distinct answers; null answers don't vote but count in total."""
    counts = candidates.groupBy(prompt, answer).agg(F.count("*").alias("votes"), F.min(idx).alias("first"))
    total = counts.groupBy(prompt).agg(F.sum("votes").alias("total"), F.max(F.when(F.col(answer).isNotNull(), F.struct("votes", (-F.col("first")).alias("f"), F.col(answer).alias("a")))).alias("w"))
    return total.select(prompt, F.col("w.a").alias(answer), F.coalesce("w.votes", F.lit(0)).cast("bigint").alias("votes"), "total", (F.coalesce(F.col("w.votes"), F.lit(0)) / F.greatest("total", F.lit(1))).alias("agreement"))


def answer_histogram(candidates: DataFrame, prompt: str, answer: str) -> DataFrame:
    return candidates.where(F.col(answer).isNotNull()).groupBy(prompt, answer).agg(F.count("*").alias("votes"))


def best_by(candidates: DataFrame, prompt: str, idx: str, score: str, keep: list[str]) -> DataFrame:
    """The row with the highest score, the lowest index among equals."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(idx)).alias("i"), *keep))
    return candidates.groupBy(prompt).agg(best.alias("b")).select(prompt, (-F.col("b.i")).alias(idx), F.col("b.s").alias(score), *[F.col(f"b.{k}").alias(k) for k in keep])


def best_of_n(candidates: DataFrame, prompt: str, idx: str, text: str, gold: str | None) -> DataFrame:
    """By reward; without a gold answer by format alone, as no length counts for a wrong answer."""
    score = reward(F.col(text), F.col(gold)) if gold else 0.3 * reward_format(F.col(text))
    return best_by(candidates.withColumn("score", score), prompt, idx, "score", [text])


def vote(candidates: DataFrame, prompt: str, idx: str, text: str, answer: str, method: str, gold: str | None = None) -> DataFrame:
    if method == "majority":
        return majority_vote(candidates, prompt, idx, answer)
    if method == "best_of_n":
        return best_of_n(candidates, prompt, idx, text, gold)
    raise ValueError(f"no such method: {method}")


def accuracy(correct: Column) -> Column:
    return F.sum(correct.cast("int")) / F.greatest(F.count("*"), F.lit(1))


def accuracy_by_operation(judged: DataFrame, op: str = "op", correct: str = "correct") -> DataFrame:
    """op, total, correct, accuracy for all four operations, zeros where there are no rows."""
    spark = judged.sparkSession
    names = spark.createDataFrame([(o,) for o in OPERATIONS], f"{op} string")
    found = judged.groupBy(op).agg(F.count("*").alias("total"), F.sum(F.col(correct).cast("int")).alias("right"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return names.join(F.broadcast(found), op, "left").select(op, zero("total").alias("total"), zero("right").alias("correct"), (zero("right") / F.greatest(zero("total"), F.lit(1))).alias("accuracy"))


def running_accuracy(judged: DataFrame, group: str | None, idx: str, correct: str, every: int) -> DataFrame:
    """group (where there is one), idx, seen, accuracy so far after every `every` rows of a group, or of one run over all rows."""
    by = [group] if group else []
    told = {"seen": prefix.rows(), "accuracy": prefix.share(F.col(correct))}
    return prefix.running(judged.select(*by, idx, correct), idx, told, by).where(F.col("seen") % every == 0).drop(correct)


def vote_metrics(results: DataFrame, correct: str = "correct", agreement: str = "agreement") -> DataFrame:
    """total, accuracy, mean_agreement (a missing one counts as 0); no row for no results."""
    out = results.agg(F.count("*").alias("total"), F.avg(F.col(correct).cast("int")).alias("accuracy"), F.avg(F.coalesce(F.col(agreement), F.lit(0.0))).alias("mean_agreement"))
    return out.where("total > 0")


def judge(completions: DataFrame, text: str, gold: str, extract, equivalent, prompt: str = "prompt") -> DataFrame:
    """Adds prediction, correct, and the prompt's first 200 characters. Completions alone are read: a prompt may hold its own answer."""
    predicted = completions.withColumn("prediction", extract(F.col(text)))
    return predicted.withColumn("correct", F.coalesce(equivalent(F.col("prediction"), F.col(gold)), F.lit(False))).withColumn("shown", F.substring(F.col(prompt), 1, 200))


def with_golds(predictions: DataFrame, golds: DataFrame, idx: str, gold: str) -> DataFrame:
    """Each prediction with the gold answer of its index; those without one, and golds without a prediction, go."""
    return predictions.join(golds.select(idx, gold), idx)


def final_answer(text: Column) -> Column:
    """What is boxed, or where that is missing or empty the last number (fractions first)."""
    return F.coalesce(F.nullif(boxed(text), F.lit("")), last_number(text))


def evaluation(completions: DataFrame, idx: str, prompt: str, text: str, gold: str, legacy: bool = False) -> DataFrame:
    """idx, shown, gold, prediction, correct: one completion a prompt. legacy: the answer is looked for in prompt and completion together, so a
    question that holds its own answer may be read as right. Null texts and golds are wrong."""
    read = F.concat(F.coalesce(F.col(prompt), F.lit("")), F.coalesce(F.col(text), F.lit(""))) if legacy else F.col(text)
    judged = judge(completions.withColumn("_read", read), "_read", gold, final_answer, is_equivalent, prompt)
    return judged.select(idx, "shown", gold, "prediction", "correct")


def voted_evaluation(completions: DataFrame, key: str, idx: str, prompt: str, text: str, gold: str) -> DataFrame:
    """key, shown, gold, prediction, correct, agreement: the majority's answer of several completions a prompt. Prompts and golds are aggregated with the
    answers' counts, so no row of a prompt is looked up again."""
    answers = completions.withColumn("prediction", final_answer(F.col(text)))
    votes = majority_vote(answers, key, idx, "prediction")
    asked = completions.groupBy(key).agg(F.min(F.substring(F.col(prompt), 1, 200)).alias("shown"), F.min(gold).alias(gold))
    correct = F.coalesce(is_equivalent(F.col("prediction"), F.col(gold)), F.lit(False))
    return votes.join(asked, key).select(key, "shown", gold, "prediction", correct.alias("correct"), "agreement")


def evaluation_summary(judged: DataFrame, correct: str = "correct") -> DataFrame:
    """One row: total, correct, accuracy; zeros for no rows."""
    right = F.coalesce(F.sum(F.col(correct).cast("bigint")), F.lit(0)).cast("bigint")
    return judged.agg(F.count(F.lit(1)).alias("total"), right.alias("correct"), (right / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("accuracy"))
