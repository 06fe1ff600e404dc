"""Queries for readers, writers, evaluations and unions of examples, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.arithmetic import problem
from sparkloom.functions.tokens import EOS, PAD
from sparkloom.operators import dialogue, judging, packing
from sparkloom.plans.corpus_queries import DOCS, LENGTH, PAIRS, SQL as CORPUS_SQL, _pairs, _packed, _PADDED, _STREAM, bigints, encoded, joined_sql
from sparkloom.plans.judge_queries import LINES, _fmt, _lines
from sparkloom.plans.stream_queries import streamed
from sparkloom.session import scratch, table
from sparkloom.sources import readers, sinks
from sparkloom.streaming.state import turn_stream


def _asked(spark, sf_dir):
    q, p, s = F.col("q"), F.col("p"), F.col("s")
    said = F.when(q % 4 == 0, _fmt("so \\boxed{", p + s, "} of ", q)).when(q % 4 == 1, _fmt("It is ", p + s)).when(q % 4 == 2, _fmt("It is ", p + s + 1)).otherwise(F.lit("I don't know"))
    return _lines(spark, sf_dir).select((F.col("k") * 100 + F.col("idx")).alias("i"), "k", "idx", _fmt("Question: What is ", p, " more than ", s, " / ", s, "?\nAnswer:").alias("prompt"), said.alias("said"), _fmt(p + s).alias("gold"))


_ASKED = f"{LINES}, asked AS (SELECT k * 100 + idx AS i, k, idx, 'Question: What is ' || p || ' more than ' || s || ' / ' || s || '?' || chr(10) || 'Answer:' AS prompt, q % 4 AS r, (p + s)::VARCHAR AS gold, CASE q % 4 WHEN 2 THEN (p + s + 1)::VARCHAR WHEN 3 THEN NULL ELSE (p + s)::VARCHAR END AS prediction FROM lines)"


def word_problem_evaluation(spark, sf_dir):
    """Rows of an evaluation that reads completions alone."""
    got = judging.evaluation(_asked(spark, sf_dir), "i", "prompt", "said", "gold")
    return got.select("i", F.md5("shown").alias("shown"), "gold", "prediction", "correct")


def legacy_evaluation(spark, sf_dir):
    """Totals of an evaluation that reads prompts too, in which a fraction of the question is taken for the answer."""
    got = judging.evaluation_summary(judging.evaluation(_asked(spark, sf_dir), "i", "prompt", "said", "gold", legacy=True))
    return got.withColumn("accuracy", F.round("accuracy", 6))


def evaluation_totals(spark, sf_dir):
    got = judging.evaluation_summary(judging.evaluation(_asked(spark, sf_dir), "i", "prompt", "said", "gold"))
    return got.withColumn("accuracy", F.round("accuracy", 6))


def competition_evaluation(spark, sf_dir):
    """Each order is a problem, its lines the completions that vote."""
    boxes = _lines(spark, sf_dir).select("k", "idx", _fmt("Problem: ", F.col("k"), "\nSolution:").alias("prompt"), _fmt("thus \\boxed{", F.col("q") % 3, "}").alias("said"), F.lit("1").alias("gold"))
    got = judging.voted_evaluation(boxes, "k", "idx", "prompt", "said", "gold")
    return got.select("k", "shown", "gold", "prediction", "correct", F.round("agreement", 6).alias("agreement"))


def sample_and_vote(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("k", "idx", _fmt("is ", F.col("q") % 3).alias("said")).withColumn("answer", judging.final_answer(F.col("said")))
    got = judging.vote(rows, "k", "idx", "said", "answer", "majority")
    return bigints(got, "votes", "total").withColumn("agreement", F.round("agreement", 6))


_VOTE3 = f"{LINES}, c AS (SELECT k, (q % 3)::VARCHAR AS answer, count(*) AS votes, min(idx) AS first FROM lines GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY votes DESC, first) AS r, sum(votes) OVER (PARTITION BY k) AS total FROM c)"


def _made(spark):
    a, b = F.col("key") * 7 % 1000, F.col("key") * 13 % 1000
    return spark.range(2_000).select(F.col("id").alias("key")).select("key", _fmt("What is ", a, " + ", b, "?").alias("question"), _fmt(a, " + ", b, " = ", a + b).alias("answer"))


_MADE = "made AS (SELECT range::BIGINT AS key, 'What is ' || (range * 7 % 1000) || ' + ' || (range * 13 % 1000) || '?' AS qu, (range * 7 % 1000) || ' + ' || (range * 13 % 1000) || ' = ' || (range * 7 % 1000 + range * 13 % 1000) AS an, (range * 7 % 1000 + range * 13 % 1000)::VARCHAR AS gold FROM range(2000))"


def _traces(spark, sf_dir):
    k = F.col("o_orderkey").cast("bigint")
    return table(spark, sf_dir, "orders").select(k.alias("key"), _fmt("P", k).alias("problem"), F.when(k % 3 == 0, "").otherwise("S").alias("solution"), F.col("o_orderstatus").alias("answer"))


def _keyed_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))


def pretraining_union(spark, sf_dir):
    """All three branches with the reference's caps."""
    got = dialogue.pretraining_rows(_made(spark), _traces(spark, sf_dir), _keyed_pairs(spark, sf_dir), "key", F.lit("general"))
    return got.select("source", "key", F.md5("text").alias("digest"))


def tuning_union(spark, sf_dir):
    """All four branches with the reference's caps."""
    k = F.col("o_orderkey").cast("bigint")
    orders = table(spark, sf_dir, "orders")
    told = orders.select(k.alias("key"), _fmt(" Status of ", k).alias("instruction"), F.when(k % 20 == 0, "").otherwise("short").alias("input"), F.when(k % 30 == 0, "<NoOutput> x").otherwise(F.concat("o_orderstatus", F.lit("\n"))).alias("output"))
    got = dialogue.tuning_rows(_made(spark), told, _traces(spark, sf_dir), _keyed_pairs(spark, sf_dir), "key", F.lit("general"))
    return got.select("source", "key", F.md5("prompt").alias("prompt"), F.md5("target").alias("target"))


def chunk_totals(spark, sf_dir):
    """What a writer of chunks counts by source while rows go by."""
    rows = encoded(spark, sf_dir, False).withColumn("tokens", F.array().cast("array<int>")).withColumn("n_tokens", F.col("n_tokens").cast("int"))
    totals = sinks.write_with_totals(rows, scratch(spark, "chunk-totals"), ["src0", "src1", "src2"])
    return spark.createDataFrame(totals, "source string, docs bigint, tokens bigint")


def manifest_fields(spark, sf_dir):
    """A manifest, read back by its fields."""
    text = sinks.manifest(encoded(spark, sf_dir, False), {"src0": 5}, {"src0": 0.4, "src1": 0.6}, 100)
    schema = "struct<docs:bigint,tokens:bigint,mean_tokens:double,chunks:bigint,plan:map<string,bigint>,ratios:map<string,double>>"
    m = text.select(F.from_json("manifest", schema).alias("m"))
    return m.select("m.docs", "m.tokens", F.round("m.mean_tokens", 6).alias("mean_tokens"), "m.chunks", F.col("m.plan")["src0"].alias("planned"), F.col("m.ratios")["src1"].alias("ratio"))


def json_records(spark, sf_dir):
    """Records written as JSON lines and read with a schema, missing fields as empty text."""
    out = scratch(spark, "json-records")
    k = F.col("o_orderkey").cast("bigint")
    table(spark, sf_dir, "orders").select(_fmt("q", k).alias("question"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("answer")).write.json(out)
    return readers.word_problems(spark, out)


def footer_count(spark, sf_dir):
    return spark.createDataFrame([(readers.row_count(spark, f"{sf_dir.rstrip('/')}/documents.parquet"),)], "n bigint")


def prefetched_documents(spark, sf_dir):
    """A staged copy, read by two readers, of which the second finds it."""
    path = scratch(spark, "prefetched")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    readers.prefetched(docs, path)
    return readers.prefetched(docs, path)


def generated_problems(spark, sf_dir):
    """A problem generated from each order's key, and whether each one's answer is its question's: differences not negative, quotients exact."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"))
    p = keys.select("id", problem(F.col("id")).alias("p")).select("id", "p.*")
    a, b, result = F.col("a"), F.col("b"), F.substring_index("answer", " = ", -1).cast("bigint")
    right = F.when(F.col("op") == "add", result == a + b).when(F.col("op") == "sub", (result == a - b) & (result >= 0)).when(F.col("op") == "mul", result == a * b).otherwise((b >= 1) & (result * b == a))
    return p.select("id", right.alias("holds"), (F.regexp_extract("question", r"What is (.*)\?", 1) == F.substring_index("answer", " = ", 1)).alias("matches"))


def pack_without_end(spark, sf_dir):
    return _packed(packing.pack_pad_tail(encoded(spark, sf_dir), "doc_id", LENGTH, EOS, PAD, append_end=False, n_ids="n_tokens"))


def stream_turn_pairs(spark, sf_dir):
    """Turn pairs as a stream of four triggers, each with whole conversations, as their order is that of conversations."""
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    return streamed(turns, "conv_id", "stream-turns", turn_stream).select("conv_id", "turn", F.md5(F.concat_ws("|", "question", "answer")).alias("digest"))


QUERIES = {f.__name__: f for f in (word_problem_evaluation, legacy_evaluation, evaluation_totals, competition_evaluation, sample_and_vote, pretraining_union, tuning_union, chunk_totals, manifest_fields, json_records, footer_count, prefetched_documents, generated_problems, pack_without_end, stream_turn_pairs)}

_TOTALS = "count(*)::BIGINT AS total, coalesce(sum(correct::INT), 0)::BIGINT AS correct, round(coalesce(sum(correct::INT), 0) / greatest(count(*), 1)::DOUBLE, 6)::DOUBLE AS accuracy"
SQL = {
    "word_problem_evaluation": f"WITH {_ASKED} SELECT i, md5(left(prompt, 200)) AS shown, gold, prediction, coalesce(prediction = gold, false) AS correct FROM asked",
    "legacy_evaluation": f"WITH {_ASKED}, j AS (SELECT r = 0 OR gold = '1' AS correct FROM asked) SELECT {_TOTALS} FROM j",
    "evaluation_totals": f"WITH {_ASKED}, j AS (SELECT coalesce(prediction = gold, false) AS correct FROM asked) SELECT {_TOTALS} FROM j",
    "competition_evaluation": f"WITH {_VOTE3} SELECT k, 'Problem: ' || k || chr(10) || 'Solution:' AS shown, '1' AS gold, answer AS prediction, answer = '1' AS correct, round(votes / total::DOUBLE, 6)::DOUBLE AS agreement FROM v WHERE r = 1",
    "sample_and_vote": f"WITH {_VOTE3} SELECT k, answer, votes::BIGINT AS votes, total::BIGINT AS total, round(votes / total::DOUBLE, 6)::DOUBLE AS agreement FROM v WHERE r = 1",
    "pretraining_union": f"""WITH {PAIRS}, {_MADE}, f AS (SELECT o_orderkey::BIGINT AS key, o_orderstatus AS st FROM orders ORDER BY o_orderkey LIMIT 50000), d AS (SELECT * FROM pairs ORDER BY key LIMIT 30000)
     SELECT source, key, md5(text) AS digest FROM (SELECT 'synthetic' AS source, key, 'Question: ' || qu || chr(10) || 'Answer: ' || an AS text FROM made
      UNION ALL SELECT 'openr1', key, 'Problem: P' || key || chr(10) || chr(10) || 'Solution:' || chr(10) || 'S' || chr(10) || chr(10) || 'Answer: ' || st FROM f WHERE key % 3 <> 0
      UNION ALL SELECT 'physics', key, '[Physics: general] ' || question || chr(10) || chr(10) || 'Assistant:' || chr(10) || answer FROM d)""",
    "tuning_union": f"""WITH {PAIRS}, {_MADE}, o AS (SELECT o_orderkey::BIGINT AS key, o_orderstatus AS st FROM orders), t AS (SELECT * FROM o WHERE key % 3 <> 0 ORDER BY key LIMIT 50000), d AS (SELECT * FROM pairs ORDER BY key LIMIT 30000)
     SELECT source, key, md5(prompt) AS prompt, md5(target) AS target FROM (SELECT 'synthetic' AS source, key, 'Question: ' || qu || chr(10) || 'Answer: <REASON>' AS prompt, an || '</REASON>' || chr(10) || '<ANSWER>' || gold || '</ANSWER>' AS target FROM made
      UNION ALL SELECT 'alpaca', key, 'Instruction: Status of ' || key || chr(10) || CASE WHEN key % 20 = 0 THEN '' ELSE 'Input: short' || chr(10) END || 'Response:', ' ' || st FROM o WHERE key % 30 <> 0
      UNION ALL SELECT 'openr1', key, 'Problem: P' || key || chr(10) || 'Solution: <REASON>', 'S</REASON>' || chr(10) || '<ANSWER>' || st || '</ANSWER>' FROM t
      UNION ALL SELECT 'physics', key, '[Physics: general] ' || question || chr(10) || 'Answer: <REASON>', answer || '</REASON>' || chr(10) || '<ANSWER>Done</ANSWER>' FROM d)""",
    "chunk_totals": f"WITH {DOCS}, n AS (SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE '' END AS source, n_tokens FROM docs) SELECT source, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens FROM n GROUP BY 1",
    "manifest_fields": f"WITH {DOCS} SELECT count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens, round(sum(n_tokens) / count(*)::DOUBLE, 6)::DOUBLE AS mean_tokens, ((count(*) + 99) // 100)::BIGINT AS chunks, 5::BIGINT AS planned, 0.6::DOUBLE AS ratio FROM docs",
    "json_records": "SELECT 'q' || o_orderkey AS question, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE '' END AS answer FROM orders",
    "footer_count": "SELECT count(*)::BIGINT AS n FROM documents",
    "prefetched_documents": "SELECT doc_id, source FROM documents",
    "generated_problems": "SELECT o_orderkey::BIGINT AS id, true AS holds, true AS matches FROM orders",
    "pack_without_end": f"WITH {DOCS}, ended AS (SELECT doc_id, tokens AS ids FROM docs), {_STREAM}, packed AS (SELECT pos // {LENGTH} AS chunk_id, list(id ORDER BY pos) AS ids FROM stream GROUP BY 1), {_PADDED} SELECT chunk_id::BIGINT AS chunk_id, len(ids)::BIGINT AS n, {joined_sql('ids')} AS digest FROM padded",
    "stream_turn_pairs": CORPUS_SQL["turn_pairs"],
}
