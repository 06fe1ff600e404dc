"""Queries for text, number, judging and policy operators, each with its SQL. Inputs are built from the tables where they hold no such texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import arithmetic, calculator, text, tokens, verify
from sparkloom.operators import dialogue, judging, policy
from sparkloom.plans.corpus_queries import bigints, encoded, joined, joined_sql
from sparkloom.session import table

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINES = f"lines AS (SELECT l_orderkey::BIGINT AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER})::BIGINT AS idx, l_partkey::BIGINT AS p, l_suppkey::BIGINT AS s, l_quantity::BIGINT AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t FROM lineitem)"


def _lines(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER.split(", ")))
    c = lambda n, t="bigint": F.col(n).cast(t)
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), rn.cast("bigint").alias("idx"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_quantity").alias("q"), c("l_discount", "double").alias("d"), c("l_tax", "double").alias("t"))


def _fmt(*parts) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"), F.col("o_custkey").cast("bigint").alias("c"))


ORDERS = "o AS (SELECT o_orderkey::BIGINT AS k, o_custkey::BIGINT AS c FROM orders)"


def _numbered(spark, sf_dir):
    k, c = F.col("k"), F.col("c")
    t = F.when(k % 5 == 0, _fmt("no digits here")).when(k % 5 == 1, _fmt("a ", k, " and -", c, ".5 end")).when(k % 5 == 2, _fmt("ratio ", k, " / ", c, " then ", k)).when(k % 5 == 3, _fmt(k, "/", c, " x -", k, " /", c)).otherwise(_fmt("  ", k, "\n"))
    return _orders(spark, sf_dir).select("k", t.alias("t"))


NUMBERED = f"{ORDERS}, n AS (SELECT k, CASE k % 5 WHEN 0 THEN 'no digits here' WHEN 1 THEN 'a ' || k || ' and -' || c || '.5 end' WHEN 2 THEN 'ratio ' || k || ' / ' || c || ' then ' || k WHEN 3 THEN k || '/' || c || ' x -' || k || ' /' || c ELSE '  ' || k || chr(10) END AS t FROM o)"


def extract_number_last(spark, sf_dir):
    return _numbered(spark, sf_dir).select("k", text.last_number(F.col("t")).alias("number"))


def extract_number_first(spark, sf_dir):
    return _numbered(spark, sf_dir).select("k", text.first_number(F.col("t")).alias("number"))


def _pick_sql(side: int) -> str:
    one = lambda re: f"regexp_extract_all(t, '{re}')[{side}]"
    return f"WITH {NUMBERED} SELECT k, coalesce(replace({one('-?[0-9]+\\s*/\\s*[0-9]+')}, ' ', ''), {one('-?[0-9]+(?:\\.[0-9]+)?')}) AS number FROM n"


def hash_answer(spark, sf_dir):
    k, c = F.col("k"), F.col("c")
    t = F.when(k % 3 == 0, _fmt("work 12 #### ", c, ",", k + 100, " rest")).when(k % 3 == 1, _fmt("#### -", k, ".25\n#### 9")).otherwise(_fmt("only ", k, " of ", c))
    return _orders(spark, sf_dir).select("k", text.hash_answer(t).alias("answer"))


def boxed(spark, sf_dir):
    k, c = F.col("k"), F.col("c")
    t = F.when(k % 4 == 0, _fmt("first \\boxed{", c, "} then \\boxed{ {", k, "} }")).when(k % 4 == 1, _fmt("boxed{", k, "}")).when(k % 4 == 2, _fmt("open \\boxed{", k)).otherwise(_fmt("none ", k))
    rows = _orders(spark, sf_dir).select("k", t.alias("t"))
    return rows.select("k", text.boxed(F.col("t")).alias("inner"), text.math_answer(F.col("t")).alias("answer"))


def calc_annotations(spark, sf_dir):
    q, p = F.col("q"), F.col("p")
    t = _fmt("has <<", q, " + ", p, " = ", q + p, ">>", q + p, " and << ", p, "*2=", p * 2, ">> left")
    return _lines(spark, sf_dir).select("k", "idx", F.md5(text.annotations_to_calls(t)).alias("digest"))


def word_problem_formats_whole(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    q, p = F.col("q"), F.col("p")
    f = dialogue.word_problem(_fmt("How many ", p, "?"), _fmt("It is <<", q, "+", p, "=", q + p, ">>", q + p, " \n#### ", q + p))
    return lines.select("k", "idx", f.alias("f")).select("k", "idx", F.md5("f.pretrain").alias("pretrain"), F.md5("f.prompt").alias("prompt"), F.md5("f.target").alias("target"), F.md5("f.ask").alias("ask"), F.col("f.gold").alias("gold"))


def competition_formats(spark, sf_dir):
    f = dialogue.competition_problem(_fmt("Find ", F.col("c")), _fmt("so \\boxed{", F.col("k"), "}"))
    return _orders(spark, sf_dir).select("k", f.alias("f")).select("k", F.md5("f.pretrain").alias("pretrain"), F.md5("f.prompt").alias("prompt"), F.md5("f.target").alias("target"), F.md5("f.ask").alias("ask"), F.col("f.gold").alias("gold"))


def synthetic_formats(spark, sf_dir):
    p, s = F.col("p"), F.col("s")
    answer = F.when(F.col("idx") % 2 == 0, _fmt("Result: 1\nResult: ", p + s, " ")).otherwise(_fmt(p, " + ", s, " = ", p + s))
    f = dialogue.synthetic_problem(_fmt(p, " + ", s), answer)
    return _lines(spark, sf_dir).select("k", "idx", f.alias("f")).select("k", "idx", F.md5("f.pretrain").alias("pretrain"), F.md5("f.target").alias("target"), F.col("f.gold").alias("gold"))


def digit_split(spark, sf_dir):
    t = _fmt("x", F.col("k"), "+-", F.col("c"), ".", F.col("k") % 1000, " end")
    return _orders(spark, sf_dir).select("k", text.digits_apart(t).alias("apart"))


def digit_collapse(spark, sf_dir):
    t = _fmt("x", F.col("k"), " + -", F.col("c"), ".", F.col("k") % 1000, " end ")
    return _orders(spark, sf_dir).select("k", text.digits_together(text.digits_apart(t)).alias("together"))


def marker_split(spark, sf_dir):
    t = _fmt("a<NUM>", F.col("k"), "</REASON><x>", F.col("c"))
    return _orders(spark, sf_dir).select("k", F.array_join(tokens.split_on_markers(t), "|").alias("pieces"), joined(tokens.encode_chars(t, bos=True)).alias("ids"))


def round_trip(spark, sf_dir):
    ids = F.col("tokens")
    plain = F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), r"(?<=\d)\s+(?=\d)", "")
    rows = encoded(spark, sf_dir)
    decoded = rows.select("doc_id", tokens.round_trips(ids, F.col("n_tokens")).alias("ok"), tokens.decode_chars(ids).alias("decoded"), text.stripped(plain).alias("plain"))
    return decoded.select("doc_id", "ok", (F.col("decoded") == F.col("plain")).alias("same"), F.length("decoded").cast("bigint").alias("n"), F.md5("decoded").alias("digest"))


def overflow_remap(spark, sf_dir):
    ids = F.array(F.col("c"), F.col("k") * 7, F.lit(32693), F.lit(32694), F.col("k") + 32758)
    return _orders(spark, sf_dir).select("k", joined(tokens.remap_overflow(ids)).alias("ids"))


def _answers(spark, sf_dir):
    q, p, i = F.col("q"), F.col("p"), F.col("k") % 8
    pred = F.when(i == 0, _fmt(q)).when(i == 1, _fmt(q, "%")).when(i == 2, _fmt(q, "/4")).when(i == 3, _fmt("x = ", q)).when(i == 4, _fmt("the answer is ", q)).when(i == 5, _fmt("$", q, ".0$")).when(i == 6, _fmt("Answer = ", q)).otherwise(_fmt("x^", q))
    gold = F.when(i == 0, _fmt(F.when(p % 2 == 0, q).otherwise(q + 1))).when(i == 1, F.when(p % 2 == 0, _fmt(q, "/100")).otherwise(_fmt(q))).when(i == 2, F.when(p % 2 == 0, _fmt(q * 2, "/8")).otherwise(_fmt(q, "/5"))).when(i == 3, F.when(p % 2 == 0, _fmt("y = ", q)).otherwise(_fmt("y = ", q, " z"))).when(i == 4, _fmt(F.when(p % 2 == 0, q).otherwise(q + 1))).when(i == 5, _fmt(q)).when(i == 6, _fmt(q)).otherwise(F.when(p % 2 == 0, _fmt("z^", q)).otherwise(_fmt("x^", q)))
    return _lines(spark, sf_dir).select("k", "idx", "q", "p", pred.alias("pred"), gold.alias("gold"))


def equivalence(spark, sf_dir):
    return _answers(spark, sf_dir).select("k", "idx", verify.is_equivalent(F.col("pred"), F.col("gold")).alias("same"))


def number_kinds(spark, sf_dir):
    return _answers(spark, sf_dir).select("k", "idx", verify.normalized(F.col("pred")).alias("n")).select("k", "idx", F.col("n.kind").alias("kind"), F.round(verify.as_double(F.col("n")), 6).alias("value"))


def reward_parts(spark, sf_dir):
    i, q, p = F.col("k") % 6, F.col("q"), F.col("p")
    good = _fmt("<REASON>r</REASON>\n<ANSWER>", q, "</ANSWER>")
    t = F.when(i == 0, good).when(i == 1, _fmt("</REASON><REASON> <ANSWER>", q, "</ANSWER>")).when(i == 2, _fmt("<ANSWER>", q, "</ANSWER><REASON></REASON> ", q)).when(i == 3, F.concat(good, F.repeat(F.lit("."), (q * 5).cast("int")), _fmt(" ", q))).when(i == 4, _fmt("plain ", q)).otherwise(_fmt("</ANSWER> <ANSWER> ", q))
    gold = _fmt(F.when(p % 3 == 0, q + 1).otherwise(q))
    rows = _lines(spark, sf_dir).select("k", "idx", t.alias("t"), gold.alias("g"))
    told = rows.select("k", "idx", verify.reward_breakdown(F.col("t"), F.col("g")).alias("r"))
    return told.select("k", "idx", *[F.round(f"r.{c}", 6).alias(c) for c in ("correct", "form", "length", "total")])


def _candidates(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("answer", (F.col("q") % 5).cast("string"))


def majority_vote(spark, sf_dir):
    got = judging.majority_vote(_candidates(spark, sf_dir), "k", "idx", "answer")
    return bigints(got, "votes", "total").withColumn("agreement", F.round("agreement", 6))


def answer_histogram(spark, sf_dir):
    return bigints(judging.answer_histogram(_candidates(spark, sf_dir), "k", "answer"), "votes")


def best_of_n(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("k", "idx", _fmt("is ", F.col("q") % 7).alias("t"), F.lit("3").alias("gold"))
    return judging.best_of_n(rows, "k", "idx", "t", "gold").select("k", "idx", F.round("score", 6).alias("score"), "t")


def paired_rewards(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("i", F.col("k") * 100 + F.col("idx"))
    paired = judging.with_golds(rows.select("i", _fmt("is ", F.col("q") % 7).alias("t")), rows.select("i", _fmt(F.col("p") % 7).alias("gold")), "i", "gold")
    return paired.select("i", F.round(verify.reward(F.col("t"), F.col("gold")), 6).alias("score"))


def rollouts(spark, sf_dir):
    got = policy.rollouts(_orders(spark, sf_dir).select("k"), 4)
    return got.select("k", F.col("rollout").cast("bigint").alias("rollout"), F.round("temperature", 6).alias("temperature"))


def vote_metrics(spark, sf_dir):
    votes = judging.majority_vote(_candidates(spark, sf_dir), "k", "idx", "answer").withColumn("correct", F.col("answer") == "2")
    got = judging.vote_metrics(votes)
    return got.select(F.col("total").cast("bigint").alias("total"), F.round("accuracy", 6).alias("accuracy"), F.round("mean_agreement", 6).alias("mean_agreement"))


def _judged(spark, sf_dir):
    i = F.col("idx") % 3
    question = F.when(i == 0, _fmt("What is ", F.col("p"), " + ", F.col("s"))).when(i == 1, _fmt(F.col("p"), " - ", F.col("s"))).otherwise(_fmt(F.col("p"), " * ", F.col("s")))
    gold = F.when(i == 0, F.col("p") + F.col("s")).when(i == 1, F.col("p") - F.col("s")).otherwise(F.col("p") * F.col("s"))
    rows = _lines(spark, sf_dir).select("k", "idx", question.alias("prompt"), _fmt("It is ", gold + F.when(F.col("q") % 4 == 0, 1).otherwise(0)).alias("completion"), _fmt(gold).alias("gold"))
    return judging.judge(rows, "completion", "gold", text.last_number, verify.is_equivalent).withColumn("op", text.operation(F.col("prompt")))


_JUDGED = f"{LINES}, judged AS (SELECT k, idx, CASE idx % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'sub' ELSE 'mul' END AS op, (q % 4 <> 0) AS correct FROM lines)"


def op_accuracy(spark, sf_dir):
    got = judging.accuracy_by_operation(_judged(spark, sf_dir))
    return got.withColumn("accuracy", F.round("accuracy", 6))


def running_accuracy(spark, sf_dir):
    got = judging.running_accuracy(_judged(spark, sf_dir).withColumn("g", F.col("k") % 50).withColumn("pos", F.col("k") * 100 + F.col("idx")), "g", "pos", "correct", 10)
    return got.select("g", "pos", F.col("seen").cast("bigint").alias("seen"), F.round("accuracy", 6).alias("accuracy"))


def running_accuracy_whole(spark, sf_dir):
    """One evaluation over all lines."""
    got = judging.running_accuracy(_judged(spark, sf_dir).withColumn("pos", F.col("k") * 100 + F.col("idx")), None, "pos", "correct", 10)
    return got.select("pos", F.col("seen").cast("bigint").alias("seen"), F.round("accuracy", 6).alias("accuracy"))


def advantages_median(spark, sf_dir):
    return policy.advantages(_lines(spark, sf_dir), "k", "d").select("k", "idx", F.round("advantage", 6).alias("advantage"))


def advantages_mean(spark, sf_dir):
    return policy.advantages(_lines(spark, sf_dir), "k", "d", median=False).select("k", "idx", F.round("advantage", 6).alias("advantage"))


def _steps(spark, sf_dir):
    return _lines(spark, sf_dir).select("k", (-F.col("t") * 5).alias("new"), (-F.col("d") * 5).alias("old"), (-F.col("d") * 3).alias("ref"), (F.col("q") - 25.0).alias("adv"), (F.col("p") % 3 != 0).alias("m"))


STEPS = f"{LINES}, st AS (SELECT k, -t * 5 AS new, -d * 5 AS old, -d * 3 AS ref, q - 25.0::DOUBLE AS adv, p % 3 <> 0 AS m, exp(-t * 5 + d * 5) AS ratio FROM lines)"
_LOSS = "coalesce(avg(-least(ratio * adv, greatest(0.8, least(1.2, ratio)) * adv)) FILTER (m), 0)"
_KL = "sum(m::INT * (new - ref)) / greatest(sum(m::INT), 1)"


def clipped_loss(spark, sf_dir):
    got = policy.clipped_loss(_steps(spark, sf_dir), "k", "new", "old", "adv", "m")
    return got.select("k", *[F.round(c, 6).alias(c) for c in ("loss", "clip_fraction", "mean_shift", "ratio_mean", "ratio_max")])


def kl(spark, sf_dir):
    return policy.divergence(_steps(spark, sf_dir), "k", "new", "ref", "m").select("k", F.round("kl", 6).alias("kl"))


def full_loss(spark, sf_dir):
    got = policy.full_loss(_steps(spark, sf_dir), "k", "new", "old", "ref", "adv", "m")
    return got.select("k", F.round("total_loss", 6).alias("total_loss"))


def log_probs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return policy.log_probs(e, "vec_id", "embedding", "label").select("vec_id", F.round("log_prob", 6).alias("log_prob"))


def topk_nucleus(spark, sf_dir):
    got = policy.sampling_filter(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.5, 20, 0.7)
    return got.select("vec_id", F.col("token").cast("bigint").alias("token"), F.round("p", 6).alias("p"))


def mean_losses(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("k", (F.col("c") % 100).cast("double").alias("l"))
    return policy.mean_loss(rows, "k", "l", 64).withColumn("loss", F.round("loss", 6))


def column_addition(spark, sf_dir):
    return _lines(spark, sf_dir).select("k", "idx", F.md5(arithmetic.worked_sum(F.col("p") * 97, F.col("k") + F.col("s"))).alias("digest"))


def column_product(spark, sf_dir):
    return _lines(spark, sf_dir).select("k", "idx", F.md5(arithmetic.worked_product(F.col("p"), F.col("s"))).alias("digest"))


def tool_calls(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("k", "idx", _fmt("a <TOOL>calc(", F.col("p"), " + ", F.col("s"), ")</TOOL> b <tool> EXEC ( ", F.col("q"), " ) </TOOL>").alias("t"))
    found = rows.select("k", "idx", F.inline(text.tool_calls(F.col("t"))))
    return bigints(found.select("k", "idx", "place", "tool", "expr", "start"), "place", "start")


def first_tool_call(spark, sf_dir):
    t = F.when(F.col("k") % 2 == 0, _fmt("a <TOOL>calc(", F.col("c"), ")</TOOL><TOOL>calc(1)</TOOL>")).otherwise(F.lit("none"))
    return _orders(spark, sf_dir).select("k", text.first_tool_call(t).alias("c")).select("k", F.col("c.tool").alias("tool"), F.col("c.expr").alias("expr"))


def tool_resolve(spark, sf_dir):
    t = _fmt("sum <TOOL>calc(", F.col("p"), " + ", F.col("s"), ")</TOOL>, twice <TOOL>calc(2*", F.col("q"), ")</TOOL>", F.when(F.col("p") % 5 == 0, "<TOOL>calc(1/0)</TOOL>").otherwise(""))
    return _lines(spark, sf_dir).select("k", "idx", calculator.resolve_udf(t).alias("r")).select("k", "idx", F.col("r.text").alias("text"), F.col("r.status").alias("status"))


def calculator_values(spark, sf_dir):
    return _lines(spark, sf_dir).select("k", "idx", calculator.calculate_udf(_fmt("max(", F.col("p"), ", ", F.col("s"), ") // 3 + ", F.col("q"), " % 7 - 2 ** 3")).alias("value"))


def lr_schedule(spark, sf_dir):
    """Orders are steps, 1,200 of them a run."""
    return _orders(spark, sf_dir).select(F.col("k").alias("step"), F.round(arithmetic.cosine_schedule(F.col("k") % 1200, 100, 1000), 6).alias("factor"))


def param_count(spark, sf_dir):
    """Parts are models, whose inner width is two to six times the model's."""
    m = {k: F.lit(v) for k, v in arithmetic.MODEL.items()}
    models = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"), (F.col("p_partkey") % 5 + 2).cast("bigint").alias("multiplier"))
    counted = arithmetic.parameter_count(**m, ffn=F.col("multiplier") * 512)
    return models.select("k", "multiplier", counted.alias("c")).select("k", "multiplier", F.col("c.per_block").cast("bigint").alias("per_block"), F.col("c.embedding").cast("bigint").alias("embedding"), F.col("c.total").cast("bigint").alias("total"))


def plan_table(spark, sf_dir):
    """How many documents each planned source needs, by the mean length of the table's."""
    mean = encoded(spark, sf_dir, False).agg((F.sum("n_tokens") / F.count(F.lit(1))).alias("mean"))
    plan = spark.createDataFrame(list(arithmetic.source_plan().items()), "source string, target bigint")
    return plan.crossJoin(F.broadcast(mean)).select("source", "target", arithmetic.documents_needed(F.col("target"), F.col("mean")).alias("documents"))


def instruction_filter(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("output", F.when(F.col("k") % 4 == 0, " <NoOutput>").otherwise(_fmt("out ", F.col("k"))))
    return rows.where(~text.is_refusal(F.col("output"))).select("k", "output")


QUERIES = {f.__name__: f for f in (extract_number_last, extract_number_first, hash_answer, boxed, calc_annotations, word_problem_formats_whole, competition_formats, synthetic_formats, digit_split, digit_collapse, marker_split, round_trip, overflow_remap, equivalence, number_kinds, reward_parts, majority_vote, answer_histogram, best_of_n, vote_metrics, paired_rewards, rollouts, op_accuracy, running_accuracy, running_accuracy_whole, advantages_median, advantages_mean, clipped_loss, kl, full_loss, log_probs, topk_nucleus, mean_losses, column_addition, column_product, tool_calls, first_tool_call, tool_resolve, calculator_values, lr_schedule, param_count, plan_table, instruction_filter)}

_SPACED = "array_to_string(string_split({}::VARCHAR, ''), ' ')"
_VOTES = f"WITH {LINES}, c AS (SELECT k, (q % 5)::VARCHAR AS answer, count(*) AS votes, min(idx) AS first FROM lines GROUP BY 1, 2), v AS (SELECT k, answer, votes, sum(votes) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY votes DESC, first) AS r FROM c)"
_CORRECT = "CASE k % 8 WHEN 3 THEN p % 2 = 0 WHEN 5 THEN true WHEN 6 THEN true WHEN 7 THEN p % 2 <> 0 ELSE p % 2 = 0 END"
_GOOD = "'<REASON>r</REASON>' || chr(10) || '<ANSWER>' || q || '</ANSWER>'"

SQL = {
    "extract_number_last": _pick_sql(-1),
    "extract_number_first": _pick_sql(1),
    "hash_answer": f"WITH {ORDERS} SELECT k, CASE k % 3 WHEN 0 THEN c || (k + 100)::VARCHAR WHEN 1 THEN '-' || k || '.25' ELSE c::VARCHAR END AS answer FROM o",
    "boxed": f"WITH {ORDERS} SELECT k, CASE k % 4 WHEN 0 THEN ' {{' || k || '}} ' WHEN 1 THEN k::VARCHAR END AS inner, CASE k % 4 WHEN 0 THEN '{{' || k || '}}' ELSE k::VARCHAR END AS answer FROM o",
    "calc_annotations": f"WITH {LINES}, t AS (SELECT k, idx, 'has <<' || q || ' + ' || p || ' = ' || (q + p) || '>>' || (q + p) || ' and << ' || p || '*2=' || (p * 2) || '>> left' AS t FROM lines) SELECT k, idx, md5(regexp_replace(t, '<<\\s*([^=\\n]+?)\\s*=\\s*[^\\n]*?>>(?:\\s*-?\\d+(?:\\.\\d+)?)?', '<TOOL>calc(\\1)</TOOL>', 'g')) AS digest FROM t",
    "word_problem_formats_whole": f"WITH {LINES}, t AS (SELECT k, idx, 'Question: How many ' || p || '?' || chr(10) AS qu, 'It is <TOOL>calc(' || q || '+' || p || ')</TOOL>' AS cot, (q + p)::VARCHAR AS g FROM lines) SELECT k, idx, md5(qu || 'Answer: ' || cot || ' ' || chr(10) || '#### ' || g) AS pretrain, md5(qu || 'Answer: <REASON>') AS prompt, md5(cot || '</REASON>' || chr(10) || '<ANSWER>' || g || '</ANSWER>') AS target, md5(qu || 'Answer:') AS ask, g AS gold FROM t",
    "competition_formats": f"WITH {ORDERS}, t AS (SELECT k, 'Problem: Find ' || c || chr(10) || 'Solution:' AS ask, 'so \\boxed{{' || k || '}}' AS s FROM o) SELECT k, md5(ask || ' ' || s) AS pretrain, md5(ask || ' <REASON>') AS prompt, md5(s || '</REASON>' || chr(10) || '<ANSWER>' || k || '</ANSWER>') AS target, md5(ask) AS ask, k::VARCHAR AS gold FROM t",
    "synthetic_formats": f"WITH {LINES}, t AS (SELECT k, idx, p || ' + ' || s AS qu, CASE WHEN idx % 2 = 0 THEN 'Result: 1' || chr(10) || 'Result: ' || (p + s) || ' ' ELSE p || ' + ' || s || ' = ' || (p + s) END AS a, (p + s)::VARCHAR AS g FROM lines) SELECT k, idx, md5('Question: ' || qu || chr(10) || 'Answer: ' || a) AS pretrain, md5(a || '</REASON>' || chr(10) || '<ANSWER>' || g || '</ANSWER>') AS target, g AS gold FROM t",
    "digit_split": f"WITH {ORDERS} SELECT k, 'x<NUM> ' || {_SPACED.format('k')} || '+<NEG> ' || {_SPACED.format('c')} || ' <DECIMAL> ' || {_SPACED.format('(k % 1000)')} || ' end' AS apart FROM o",
    "digit_collapse": f"WITH {ORDERS} SELECT k, 'x' || k || ' + -' || c || '.' || (k % 1000) || ' end' AS together FROM o",
    "marker_split": f"""WITH {ORDERS}, t AS (SELECT k, '</REASON>' AS m, k::VARCHAR AS a, '<x>' || c AS b FROM o) SELECT k, 'a|<NUM>|' || a || '|</REASON>|' || b AS pieces,
     {joined_sql("list_concat([32766, 97, 32758], list_concat(list_transform(string_split(a, ''), lambda x: ascii(x)), list_concat([32762], list_transform(string_split(b, ''), lambda x: ascii(x)))))")} AS ids FROM t""",
    "round_trip": """WITH a AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM documents WHERE text <> ''),
     b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([0-9])\\s+([0-9])', '\\1\\2', 'g'), '([0-9])\\s+([0-9])', '\\1\\2', 'g') AS t FROM a), c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^\\s+', ''), '\\s+$', '') AS t FROM b)
     SELECT doc_id, t <> '' AS ok, true AS same, length(t)::BIGINT AS n, md5(t) AS digest FROM c""",
    "overflow_remap": f"WITH {ORDERS} SELECT k, {joined_sql('list_transform([c, k * 7, 32693, 32694, k + 32758], lambda i: CASE WHEN i < 32694 THEN i ELSE 32694 + i % 64 END)')} AS ids FROM o",
    "equivalence": f"WITH {LINES} SELECT k, idx, {_CORRECT} AS same FROM lines",
    "number_kinds": f"WITH {LINES} SELECT k, idx, CASE k % 8 WHEN 2 THEN 'ratio' WHEN 3 THEN 'sym' WHEN 4 THEN 'sym' WHEN 6 THEN 'sym' WHEN 7 THEN 'sym' ELSE 'num' END AS kind, round(CASE k % 8 WHEN 0 THEN q::DOUBLE WHEN 1 THEN q / 100.0::DOUBLE WHEN 2 THEN q / 4.0::DOUBLE WHEN 5 THEN q::DOUBLE END, 6) AS value FROM lines",
    "reward_parts": f"""WITH {LINES}, t AS (SELECT k, idx, p % 3 <> 0 AS good, CASE k % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 WHEN 3 THEN 1.0 WHEN 4 THEN 0.0 ELSE 0.25 END::DOUBLE AS form,
     CASE WHEN k % 6 = 3 THEN length({_GOOD}) + q * 5 + 1 + length(q::VARCHAR) ELSE 1 END AS n FROM lines),
     r AS (SELECT k, idx, good::INT::DOUBLE AS correct, form, CASE WHEN NOT good THEN 0 WHEN n <= 200 THEN 1 WHEN n >= 400 THEN 0 ELSE 1 - (n - 200) / 200.0::DOUBLE END::DOUBLE AS length FROM t)
     SELECT k, idx, correct, form, round(length, 6) AS length, round(correct + 0.3::DOUBLE * form + 0.2::DOUBLE * length, 6) AS total FROM r""",
    "majority_vote": f"{_VOTES} SELECT k, answer, votes::BIGINT AS votes, total::BIGINT AS total, round(votes / total::DOUBLE, 6) AS agreement FROM v WHERE r = 1",
    "answer_histogram": f"WITH {LINES} SELECT k, (q % 5)::VARCHAR AS answer, count(*)::BIGINT AS votes FROM lines GROUP BY 1, 2",
    "best_of_n": f"WITH {LINES}, r AS (SELECT k, idx, CASE WHEN q % 7 = 3 THEN 1.2::DOUBLE ELSE 0::DOUBLE END AS score, 'is ' || (q % 7) AS t FROM lines) SELECT k, idx, score, t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, idx) AS n FROM r) WHERE n = 1",
    "paired_rewards": f"WITH {LINES} SELECT k * 100 + idx AS i, CASE WHEN q % 7 = p % 7 THEN 1.2::DOUBLE ELSE 0::DOUBLE END AS score FROM lines",
    "rollouts": f"WITH {ORDERS} SELECT k, r.range::BIGINT AS rollout, round(0.7::DOUBLE + 0.05::DOUBLE * r.range, 6)::DOUBLE AS temperature FROM o, range(4) r",
    "vote_metrics": f"{_VOTES} SELECT count(*)::BIGINT AS total, round(avg((answer = '2')::INT), 6)::DOUBLE AS accuracy, round(avg(votes / total::DOUBLE), 6)::DOUBLE AS mean_agreement FROM v WHERE r = 1",
    "op_accuracy": f"WITH {_JUDGED}, n(op) AS (VALUES ('add'), ('sub'), ('mul'), ('div')) SELECT n.op, count(j.op)::BIGINT AS total, coalesce(sum(j.correct::INT), 0)::BIGINT AS correct, round(coalesce(sum(j.correct::INT), 0)::DOUBLE / greatest(count(j.op), 1), 6)::DOUBLE AS accuracy FROM n LEFT JOIN judged j USING (op) GROUP BY n.op",
    "running_accuracy": f"WITH {_JUDGED}, r AS (SELECT k % 50 AS g, k * 100 + idx AS pos, count(*) OVER w AS seen, avg(correct::INT) OVER w AS accuracy FROM judged WINDOW w AS (PARTITION BY k % 50 ORDER BY k * 100 + idx ROWS UNBOUNDED PRECEDING)) SELECT g, pos, seen::BIGINT AS seen, round(accuracy, 6)::DOUBLE AS accuracy FROM r WHERE seen % 10 = 0",
    "running_accuracy_whole": f"WITH {_JUDGED}, r AS (SELECT k * 100 + idx AS pos, count(*) OVER w AS seen, avg(correct::INT) OVER w AS accuracy FROM judged WINDOW w AS (ORDER BY k * 100 + idx ROWS UNBOUNDED PRECEDING)) SELECT pos, seen::BIGINT AS seen, round(accuracy, 6)::DOUBLE AS accuracy FROM r WHERE seen % 10 = 0",
    "advantages_median": f"WITH {LINES} SELECT k, idx, (round(d - median(d) OVER (PARTITION BY k), 6) + 0.0::DOUBLE)::DOUBLE AS advantage FROM lines",
    "advantages_mean": f"WITH {LINES} SELECT k, idx, (round(d - avg(d) OVER (PARTITION BY k), 6) + 0.0::DOUBLE)::DOUBLE AS advantage FROM lines",
    "clipped_loss": f"WITH {STEPS} SELECT k, round({_LOSS}, 6)::DOUBLE AS loss, round(coalesce(avg((abs(ratio - 1) > 0.2)::INT) FILTER (m), 0), 6)::DOUBLE AS clip_fraction, round(coalesce(avg(new - old) FILTER (m), 0), 6)::DOUBLE AS mean_shift, round(CASE WHEN count(*) FILTER (m) > 0 THEN avg(ratio) ELSE 0 END, 6)::DOUBLE AS ratio_mean, round(CASE WHEN count(*) FILTER (m) > 0 THEN max(ratio) ELSE 0 END, 6)::DOUBLE AS ratio_max FROM st GROUP BY k",
    "kl": f"WITH {STEPS} SELECT k, round({_KL}, 6)::DOUBLE AS kl FROM st GROUP BY k",
    "full_loss": f"WITH {STEPS} SELECT k, round({_LOSS} + 0.04 * {_KL}, 6)::DOUBLE AS total_loss FROM st GROUP BY k",
    "log_probs": "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS l, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, round(max(l) FILTER (i = label) - ln(sum(exp(l))), 6)::DOUBLE AS log_prob FROM x GROUP BY vec_id",
    "topk_nucleus": "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE / 0.5 AS l, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings), t AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY l DESC) AS r FROM x) WHERE r <= 20), p AS (SELECT vec_id, token, l, exp(l) / sum(exp(l)) OVER (PARTITION BY vec_id) AS p FROM t), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY l DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT vec_id, token::BIGINT AS token, round(p, 6)::DOUBLE AS p FROM c WHERE round(b, 9) <= 0.7",
    "mean_losses": f"WITH {ORDERS} SELECT (k // 64)::BIGINT AS \"window\", round(avg((c % 100)::DOUBLE), 6)::DOUBLE AS loss FROM o GROUP BY 1",
    "column_addition": f"""WITH RECURSIVE {LINES}, ab AS (SELECT k, idx, p * 97 AS a, k + s AS b FROM lines),
     c AS (SELECT k, idx, a, b, i, (a // (10 ** i)::BIGINT) % 10 AS da, (b // (10 ** i)::BIGINT) % 10 AS db, (a % (10 ** i)::BIGINT + b % (10 ** i)::BIGINT) // (10 ** i)::BIGINT AS carry, greatest(length(a::VARCHAR), length(b::VARCHAR)) AS n FROM ab, range(12) r(i) WHERE i < length((a + b)::VARCHAR)),
     l AS (SELECT *, da + db + carry AS t, rpad(['ones','tens','hundreds','thousands','ten-thousands','hundred-thousands','millions','ten-millions','hundred-millions'][i + 1], greatest(14, length(['ones','tens','hundreds','thousands','ten-thousands','hundred-thousands','millions','ten-millions','hundred-millions'][i + 1]))::INTEGER, ' ') AS place FROM c),
     x AS (SELECT k, idx, a, b, i, place || ' ' || CASE WHEN i >= n THEN '0+0+' || carry ELSE da || '+' || db || CASE WHEN carry > 0 THEN '+' || carry ELSE '' END END || ' = ' || t || ', write ' || (t % 10) || CASE WHEN t >= 10 THEN ', carry ' || (t // 10) ELSE '' END AS line FROM l)
     SELECT k, idx, md5(string_agg(line, chr(10) ORDER BY i) || chr(10) || 'Result: ' || (max(a) + max(b))) AS digest FROM x GROUP BY k, idx""",
    "column_product": f"""WITH {LINES}, d AS (SELECT k, idx, p, s, i, (s // (10 ** i)::BIGINT) % 10 AS d FROM lines, range(10) r(i) WHERE i < length(s::VARCHAR)),
     x AS (SELECT k, idx, p, s, i, p * d * (10 ** i)::BIGINT AS part, p || ' × ' || d || CASE WHEN i > 0 THEN ' (×10^' || i || ')' ELSE '' END || ' = ' || (p * d * (10 ** i)::BIGINT) AS line FROM d)
     SELECT k, idx, md5(string_agg(line, chr(10) ORDER BY i) || CASE WHEN max(s) >= 10 THEN chr(10) || string_agg(part::VARCHAR, ' + ' ORDER BY i) || ' = ' || max(p * s) ELSE '' END || chr(10) || 'Result: ' || max(p * s)) AS digest FROM x GROUP BY k, idx""",
    "tool_calls": f"WITH {LINES} SELECT k, idx, 0::BIGINT AS place, 'calc' AS tool, p || ' + ' || s AS expr, 2::BIGINT AS start FROM lines UNION ALL SELECT k, idx, 1, 'exec', q::VARCHAR, length('a <TOOL>calc(' || p || ' + ' || s || ')</TOOL> b ') FROM lines",
    "first_tool_call": f"WITH {ORDERS} SELECT k, CASE WHEN k % 2 = 0 THEN 'calc' END AS tool, CASE WHEN k % 2 = 0 THEN c::VARCHAR END AS expr FROM o",
    "tool_resolve": f"WITH {LINES} SELECT k, idx, 'sum ' || (p + s) || ', twice ' || (2 * q) || CASE WHEN p % 5 = 0 THEN '<TOOL>calc(1/0)</TOOL>' ELSE '' END AS text, CASE WHEN p % 5 = 0 THEN 'error' ELSE 'ok' END AS status FROM lines",
    "calculator_values": f"WITH {LINES} SELECT k, idx, (greatest(p, s) // 3 + q % 7 - 8)::VARCHAR AS value FROM lines",
    "lr_schedule": "SELECT k AS step, round(CASE WHEN range < 100 THEN range / 100.0::DOUBLE WHEN range >= 1000 THEN 0.1 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (range - 100) / 900.0::DOUBLE)) END, 6)::DOUBLE AS factor FROM (SELECT o_orderkey::BIGINT AS k, o_orderkey % 1200 AS range FROM orders)",
    "param_count": "WITH m AS (SELECT k, range::BIGINT AS multiplier, 4 * 512 * 512 + 13 * 512 + 2 * 512 * (64 + 64 + 32 + 128) + 512 + 512 + 2 * 512 * range * 512 + 4 * 512 AS b FROM (SELECT p_partkey::BIGINT AS k, p_partkey % 5 + 2 AS range FROM part)) SELECT k, multiplier, b::BIGINT AS per_block, 16777216::BIGINT AS embedding, (16777216 + 8 * b + 1024 + 1024)::BIGINT AS total FROM m",
    "plan_table": """WITH m AS (SELECT sum(length(text))::DOUBLE / count(*) AS mean FROM documents WHERE text <> ''), p(source, target) AS (VALUES ('ultradata_math', 800000000::BIGINT), ('fineweb_edu', 600000000), ('python_code', 600000000))
     SELECT source, target, floor(target / mean * 1.15::DOUBLE)::BIGINT AS documents FROM p, m""",
    "instruction_filter": f"WITH {ORDERS} SELECT k, 'out ' || k AS output FROM o WHERE k % 4 <> 0",
}
for _k in ("boxed", "competition_formats"):
    SQL[_k] = SQL[_k].replace("{{", "{").replace("}}", "}")
