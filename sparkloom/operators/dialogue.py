"""Turns to pairs, and examples from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import annotations_to_calls, hash_answer, is_refusal, last_result, math_answer, stripped
from sparkloom.operators.selection import first_n


def speaker(role: Column) -> Column:
    """USER or ASSISTANT by what the role contains; null for others."""
    up = F.upper(role)
    return F.when(F.contains(up, F.lit("USER")), "USER").when(F.contains(up, F.lit("ASSISTANT")), "ASSISTANT")


def turn_pairs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, turn, question, answer: an assistant's turn with the user's turn right before it, others and empty ones aside. Pairs don't
    cross conversations."""
    said = turns.withColumn("_s", speaker(F.col(role))).where("_s is not null").where(F.coalesce(F.col(text), F.lit("")) != "")
    w = W.partitionBy(conversation).orderBy(turn)
    paired = said.withColumn("_before", F.lag("_s").over(w)).withColumn("question", F.lag(text).over(w))
    return paired.where("_s = 'ASSISTANT' and _before = 'USER'").select(conversation, turn, "question", F.col(text).alias("answer"))


def dialogue_text(field: Column, question: Column, answer: Column) -> Column:
    return F.concat(F.lit("[Physics: "), field, F.lit("] "), question, F.lit("\n\nAssistant:\n"), answer)


def dialogue_prompt(field: Column, question: Column) -> Column:
    return F.concat(F.lit("[Physics: "), field, F.lit("] "), question, F.lit("\nAnswer: <REASON>"))


def reasoned(reason: Column, answer: Column) -> Column:
    return F.concat(reason, F.lit("</REASON>\n<ANSWER>"), answer, F.lit("</ANSWER>"))


def word_problem(question: Column, answer: Column, convert: bool = True) -> Column:
    """struct(pretrain, prompt, target, ask, gold) of a worked answer that ends in `#### number`."""
    worked = annotations_to_calls(answer) if convert else answer
    ended = F.contains(worked, F.lit("####"))
    parts = F.split(worked, "####", 2)
    return F.struct(
        F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), worked).alias("pretrain"),
        F.concat(F.lit("Question: "), question, F.lit("\nAnswer: <REASON>")).alias("prompt"),
        reasoned(stripped(parts[0]), F.when(ended, stripped(F.get(parts, F.lit(1)))).otherwise("")).alias("target"),
        F.concat(F.lit("Question: "), question, F.lit("\nAnswer:")).alias("ask"),
        F.coalesce(hash_answer(answer), F.lit("")).alias("gold"),
    )


def competition_problem(problem: Column, solution: Column) -> Column:
    gold = F.coalesce(math_answer(solution), F.lit(""))
    return F.struct(
        F.concat(F.lit("Problem: "), problem, F.lit("\nSolution: "), solution).alias("pretrain"),
        F.concat(F.lit("Problem: "), problem, F.lit("\nSolution: <REASON>")).alias("prompt"),
        reasoned(solution, gold).alias("target"),
        F.concat(F.lit("Problem: "), problem, F.lit("\nSolution:")).alias("ask"),
        gold.alias("gold"),
    )


def synthetic_problem(question: Column, answer: Column) -> Column:
    gold = last_result(answer)
    return F.struct(
        F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer).alias("pretrain"),
        F.concat(F.lit("Question: "), question, F.lit("\nAnswer: <REASON>")).alias("prompt"),
        reasoned(answer, gold).alias("target"),
        F.concat(F.lit("Question: "), question, F.lit("\nAnswer:")).alias("ask"),
        gold.alias("gold"),
    )


def instruction_rows(df: DataFrame, key: str) -> DataFrame:
    """source, key, prompt, target of rows with instruction, input, output; rows without instruction or output, and refusals, go."""
    t = {c: stripped(F.coalesce(F.col(c), F.lit(""))) for c in ("instruction", "input", "output")}
    prompt = F.concat(F.lit("Instruction: "), t["instruction"], F.lit("\n"), F.when(t["input"] != "", F.concat(F.lit("Input: "), t["input"], F.lit("\n"))).otherwise(""), F.lit("Response:"))
    return df.where((t["instruction"] != "") & (t["output"] != "") & ~is_refusal(F.coalesce(F.col("output"), F.lit("")))).select(F.lit("alpaca").alias("source"), key, prompt.alias("prompt"), F.concat(F.lit(" "), t["output"]).alias("target"))


def trace_rows(df: DataFrame, key: str, kept: int = 50_000) -> DataFrame:
    """source, key, prompt, target of the first `kept` rows with problem and solution."""
    rows = first_n(df.where((F.coalesce(F.col("problem"), F.lit("")) != "") & (F.coalesce(F.col("solution"), F.lit("")) != "")), kept, key)
    return rows.select(F.lit("openr1").alias("source"), key, F.concat(F.lit("Problem: "), F.col("problem"), F.lit("\nSolution: <REASON>")).alias("prompt"), reasoned(F.col("solution"), F.coalesce(F.col("answer"), F.lit(""))).alias("target"))


def trace_texts(df: DataFrame, key: str, examined: int = 50_000) -> DataFrame:
    """source, key, text of those of the first `examined` rows that have problem and solution."""
    rows = first_n(df, examined, key).where((F.coalesce(F.col("problem"), F.lit("")) != "") & (F.coalesce(F.col("solution"), F.lit("")) != ""))
    return rows.select(F.lit("openr1").alias("source"), key, F.concat(F.lit("Problem: "), F.col("problem"), F.lit("\n\nSolution:\n"), F.col("solution"), F.lit("\n\nAnswer: "), F.coalesce(F.col("answer"), F.lit(""))).alias("text"))


def dialogue_rows(pairs: DataFrame, key: str, field: Column, most: int = 30_000) -> DataFrame:
    rows = first_n(pairs, most, key)
    return rows.select(F.lit("physics").alias("source"), key, dialogue_prompt(field, F.col("question")).alias("prompt"), reasoned(F.col("answer"), F.lit("Done")).alias("target"))


def dialogue_texts(pairs: DataFrame, key: str, field: Column, most: int = 30_000) -> DataFrame:
    """source, key, text of the first `most` pairs."""
    rows = first_n(pairs, most, key)
    return rows.select(F.lit("physics").alias("source"), key, dialogue_text(field, F.col("question"), F.col("answer")).alias("text"))


def pretraining_rows(synthetic: DataFrame, traces: DataFrame, pairs: DataFrame, key: str, field: Column, examined: int = 50_000, most: int = 30_000) -> DataFrame:
    """source, key, text: worked problems (question, answer), those of the first `examined` traces that are whole, and the first `most` pairs."""
    made = synthetic.select(F.lit("synthetic").alias("source"), key, synthetic_problem(F.col("question"), F.col("answer"))["pretrain"].alias("text"))
    return made.unionByName(trace_texts(traces, key, examined)).unionByName(dialogue_texts(pairs, key, field, most))


def tuning_rows(synthetic: DataFrame, instructions: DataFrame, traces: DataFrame, pairs: DataFrame, key: str, field: Column, kept: int = 50_000, most: int = 30_000) -> DataFrame:
    """source, key, prompt, target: worked problems, instructions, the first `kept` whole traces, and the first `most` pairs."""
    f = synthetic_problem(F.col("question"), F.col("answer"))
    made = synthetic.select(F.lit("synthetic").alias("source"), key, f["prompt"].alias("prompt"), f["target"].alias("target"))
    return made.unionByName(instruction_rows(instructions, key)).unionByName(trace_rows(traces, key, kept)).unionByName(dialogue_rows(pairs, key, field, most))


def problem_solution_rows(df: DataFrame, key: str, first: str, second: str, cap: int) -> DataFrame:
    """key, text of the first max(cap, 1) rows with both fields."""
    rows = first_n(df.where((F.coalesce(F.col(first), F.lit("")) != "") & (F.coalesce(F.col(second), F.lit("")) != "")), max(cap, 1), key)
    return rows.select(key, F.concat(F.lit("Problem: "), F.col(first), F.lit("\nSolution: "), F.col(second)).alias("text"))


def ordered_union(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """The frames' rows with their source and its rank, which keeps the order of concatenation."""
    out = None
    for rank, (source, df) in enumerate(frames):
        own = df.withColumn("source", F.lit(source)).withColumn("source_rank", F.lit(rank))
        out = own if out is None else out.unionByName(own)
    return out
