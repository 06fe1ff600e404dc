"""Queries over whole tables for the corpus operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.arithmetic import problem
from sparkloom.functions.tokens import EOS, PAD, encode_chars, estimated_row_bytes, next_token_pair
from sparkloom.operators import corpus, dialogue, mixture, packing
from sparkloom.session import table

CHARS = "list_transform(string_split(text, ''), lambda c: CASE WHEN ascii(c) < 128 THEN ascii(c) ELSE 63 END)"
DOCS = f"docs AS (SELECT doc_id, text, source, {CHARS} AS tokens, length(text)::BIGINT AS n_tokens FROM documents WHERE text <> '')"
PLAN = {"src0": (30_000, 1_000_000), "src1": (1_000_000, 20), "src2": (20_000, 10)}
PLAN_SQL = "plan(source, target, cap) AS (VALUES ('src0', 30000, 1000000), ('src1', 1000000, 20), ('src2', 20000, 10))"
LENGTH = 512


def encoded(spark: SparkSession, sf_dir: str, tokens: bool = True) -> DataFrame:
    """Documents with character tokens. n_tokens is the text's length, so a plan that needs counts alone builds no array."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").withColumn("n_tokens", F.length("text").cast("bigint"))
    return docs.withColumn("tokens", encode_chars(F.col("text"))) if tokens else docs


def joined(ids) -> F.Column:
    return F.md5(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","))


def joined_sql(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def bigints(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in columns else F.col(c) for c in df.columns])


def source_stats(spark, sf_dir):
    return bigints(corpus.source_stats(encoded(spark, sf_dir, False)), "docs", "tokens")


def shard_stats(spark, sf_dir):
    rows = encoded(spark, sf_dir, False).withColumn("shard", F.floor(F.col("doc_id") / 100).cast("bigint"))
    return bigints(corpus.shard_stats(corpus.only_sources(rows, ["src0", "src1", "src2"])), "docs", "tokens")


def _running(got: DataFrame) -> DataFrame:
    return bigints(got, "docs", "tokens", "shortest", "longest").withColumn("mean_tokens", F.round("mean_tokens", 6))


def running_totals(spark, sf_dir):
    """Totals up to each document, in one run over all."""
    return _running(corpus.running_stats(encoded(spark, sf_dir, False), "doc_id")).drop("source")


def running_source_totals(spark, sf_dir):
    return _running(corpus.running_stats(encoded(spark, sf_dir, False), "doc_id", by_source=True))


def running_legacy_rate(spark, sf_dir):
    """The share of legacy code among what has been examined, as it is told while a source is filtered."""
    got = mixture.running_legacy_rate(_code(spark, sf_dir), "k", 100)
    return bigints(got, "examined").withColumn("rejected_percent", F.round("rejected_percent", 6))


def encode_stats(spark, sf_dir):
    e = encoded(spark, sf_dir)
    return e.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), joined(F.col("tokens")).alias("digest"))


def budget_mixture(spark, sf_dir):
    kept = mixture.budget_cut(encoded(spark, sf_dir, False), mixture.plan_table(spark, PLAN), "doc_id")
    return bigints(kept.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("doc_id").alias("last_doc")), "docs", "tokens", "last_doc")


def budget_rows(spark, sf_dir):
    return mixture.budget_cut(encoded(spark, sf_dir, False), mixture.plan_table(spark, PLAN), "doc_id").select("doc_id", "source", "n_tokens")


def estimated_cut(spark, sf_dir):
    return mixture.estimated_cut(table(spark, sf_dir, "documents"), 210_000, "doc_id").select("doc_id", "source")


def estimated_cut_whole(spark, sf_dir):
    """With the reference's target."""
    return mixture.estimated_cut(table(spark, sf_dir, "documents"), 600_000_000, "doc_id").select("doc_id", "source")


def quality_take(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return mixture.quality_take(rows, "quality", 1, 50, 42, "doc_id").select("doc_id", "source")


def _code(spark, sf_dir):
    k = F.col("p_partkey")
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("x = 1\nprint \""), k.cast("string"), F.lit('"')))
        .when(k % 7 == 1, F.lit("class A( object ):\n  pass"))
        .when(k % 7 == 2, F.lit("s = u'abc'"))
        .when(k % 7 == 3, F.lit(""))
        .when(k % 11 == 4, F.lit("apply (f, x)"))
        .when(k % 13 == 5, F.lit("exec 'x'"))
        .otherwise(F.concat(F.lit("def f():\n  return "), k.cast("string")))
    )
    return table(spark, sf_dir, "part").select(k.cast("bigint").alias("k"), text.alias("code"))


CODE_SQL = """code AS (SELECT p_partkey::BIGINT AS k, CASE WHEN p_partkey % 7 = 0 THEN 'x = 1' || chr(10) || 'print "' || p_partkey || '"'
  WHEN p_partkey % 7 = 1 THEN 'class A( object ):' || chr(10) || '  pass' WHEN p_partkey % 7 = 2 THEN 's = u''abc''' WHEN p_partkey % 7 = 3 THEN ''
  WHEN p_partkey % 11 = 4 THEN 'apply (f, x)' WHEN p_partkey % 13 = 5 THEN 'exec ''x''' ELSE 'def f():' || chr(10) || '  return ' || p_partkey END AS code FROM part),
 seen AS (SELECT k, code, row_number() OVER (ORDER BY k) AS examined,
  NOT (regexp_matches(code, '(?:^|\\n)\\s*print\\s+["'']') OR regexp_matches(code, '(?:^|\\n)\\s*class\\s+\\w+\\s*\\(\\s*object\\s*\\)\\s*:')
   OR regexp_matches(code, '\\bu["'']') OR regexp_matches(code, '\\bapply\\s*\\(') OR regexp_matches(code, '\\bexec\\s+[''"]')) AS passes
  FROM code WHERE code <> '')"""


def legacy_filter_cap(spark, sf_dir):
    return mixture.current_code(_code(spark, sf_dir), 200, "k").select("k")


def legacy_rate(spark, sf_dir):
    got = mixture.legacy_rate(_code(spark, sf_dir))
    return bigints(got, "examined", "rejected").withColumn("rejected_percent", F.round("rejected_percent", 6))


def two_field_filter_whole(spark, sf_dir):
    """With the reference's cap."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("role"), "text")
    got = dialogue.problem_solution_rows(c, "key", "role", "text", 50_000)
    return got.select("key", F.md5("text").alias("digest"))


def _sharded(spark, sf_dir):
    return encoded(spark, sf_dir, False).withColumn("shard", F.floor(F.col("doc_id") / 100).cast("bigint"))


def holdout_split(spark, sf_dir):
    return corpus.holdout(_sharded(spark, sf_dir), 0.05, "shard", "doc_id").select("doc_id", "shard", "held_out")


def holdout_difference(spark, sf_dir):
    rows = _sharded(spark, sf_dir)
    return corpus.without(rows, corpus.validation_rows(rows, 0.05, "shard", "doc_id"), "doc_id").select("doc_id")


def val_sample(spark, sf_dir):
    held = corpus.validation_rows(_sharded(spark, sf_dir), 0.2, "shard", "doc_id")
    return corpus.validation_sample(held, 100, 1000, 7, "doc_id").select("doc_id", "n_tokens")


def shuffle_batches(spark, sf_dir):
    return corpus.fixed_batches(table(spark, sf_dir, "documents").select("doc_id"), 16, 11, "doc_id")


def token_offsets(spark, sf_dir):
    rows = encoded(spark, sf_dir, False).withColumn("w", F.col("n_tokens") + 1)
    return corpus.with_position(rows, "doc_id", "w").select("doc_id", "position")


def _packed(df):
    return df.select("chunk_id", F.size("input_ids").cast("bigint").alias("n"), joined(F.col("input_ids")).alias("digest"))


def pack_drop_tail(spark, sf_dir):
    return _packed(packing.pack_drop_tail(encoded(spark, sf_dir), "doc_id", LENGTH, EOS, n_ids="n_tokens"))


def pack_resume(spark, sf_dir):
    return _packed(packing.pack_drop_tail(encoded(spark, sf_dir), "doc_id", LENGTH, None, skip=100, n_ids="n_tokens"))


def pack_pad_labels(spark, sf_dir):
    got = packing.pack_pad_tail(encoded(spark, sf_dir), "doc_id", LENGTH, EOS, PAD, n_ids="n_tokens")
    return got.select("chunk_id", F.size("input_ids").cast("bigint").alias("n"), joined(F.col("input_ids")).alias("digest"), joined(F.col("labels")).alias("labels"))


def _pairs(spark, sf_dir):
    return dialogue.turn_pairs(table(spark, sf_dir, "conversations"))


PAIRS = """said AS (SELECT conv_id, turn, text, CASE WHEN upper(role) LIKE '%USER%' THEN 'U' WHEN upper(role) LIKE '%ASSISTANT%' THEN 'A' END AS s FROM conversations WHERE text <> ''),
 lagged AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM said WHERE s IS NOT NULL),
 pairs AS (SELECT conv_id, turn, question, text AS answer, conv_id * 1000 + turn AS key FROM lagged WHERE s = 'A' AND before = 'U')"""


def pack_prompt_mask(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), encode_chars(F.col("question")).alias("prompt_ids"), encode_chars(F.col("answer")).alias("target_ids"))
    got = packing.pack_prompt_mask(rows, "key", LENGTH, EOS, PAD)
    return got.select("chunk_id", F.size("input_ids").cast("bigint").alias("n"), joined(F.col("input_ids")).alias("digest"), joined(F.col("labels")).alias("labels"))


def shift_pairs(spark, sf_dir):
    got = packing.pack_drop_tail(encoded(spark, sf_dir), "doc_id", LENGTH, EOS, n_ids="n_tokens").select("chunk_id", next_token_pair(F.col("input_ids")).alias("p"))
    return got.select("chunk_id", joined(F.col("p.inputs")).alias("inputs"), joined(F.col("p.labels")).alias("labels"))


def chunk_ids_rows(spark, sf_dir):
    return mixture.chunk_by_rows(encoded(spark, sf_dir, False), "doc_id", 77).select("doc_id", "chunk_id")


def chunk_ids_both(spark, sf_dir):
    return mixture.chunk_by_rows_and_bytes(encoded(spark, sf_dir, False), "doc_id", 10, 40_000).select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"))


def row_bytes(spark, sf_dir):
    return encoded(spark, sf_dir, False).select("doc_id", estimated_row_bytes(F.col("n_tokens"), F.col("source")).alias("bytes"))


def turn_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.md5(F.concat_ws("|", "question", "answer")).alias("digest"))


def length_buckets(spark, sf_dir):
    got = corpus.length_buckets(encoded(spark, sf_dir, False), 5, 3, "doc_id")
    return got.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), "n_tokens")


def sample_per_source(spark, sf_dir):
    return mixture.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), 5, "source", 5, "doc_id")


def ordered_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    frames = [(s, docs.where(F.col("source") == s).select("doc_id")) for s in ("src2", "src0", "src1")]
    return bigints(dialogue.ordered_union(frames), "source_rank")


def _sft_branches(spark, sf_dir) -> DataFrame:
    """Instructions, traces and dialogues, with the reference's caps, which are the operators' own."""
    field, orders = F.lit("general"), table(spark, sf_dir, "orders")
    pairs = dialogue.dialogue_rows(_pairs(spark, sf_dir).withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "key", field)
    instructions = dialogue.instruction_rows(orders.select(F.col("o_orderkey").cast("bigint").alias("key"), F.concat(F.lit(" Status of "), F.col("o_orderkey").cast("string")).alias("instruction"), F.when(F.col("o_orderkey") % 20 == 0, "").otherwise("short").alias("input"), F.when(F.col("o_orderkey") % 30 == 0, "<NoOutput> x").otherwise(F.concat(F.col("o_orderstatus"), F.lit("\n"))).alias("output")), "key")
    traces = dialogue.trace_rows(orders.select(F.col("o_orderkey").cast("bigint").alias("key"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("problem"), F.when(F.col("o_orderkey") % 40 == 0, "").otherwise("S").alias("solution"), F.col("o_orderstatus").alias("answer")), "key")
    return instructions.unionByName(traces).unionByName(pairs)


def _digested(examples: DataFrame) -> DataFrame:
    return examples.select("source", "key", F.md5("prompt").alias("prompt"), F.md5("target").alias("target"))


def sft_union(spark, sf_dir):
    """The branches that come from tables."""
    return _digested(_sft_branches(spark, sf_dir))


def sft_union_whole(spark, sf_dir):
    """All four branches over whole tables with the reference's caps. The generated problems rest on a Spark hash, so there is no SQL for them."""
    p = problem(F.col("id"))
    made = dialogue.synthetic_problem(p["question"], p["answer"])
    synthetic = spark.range(2_000).select(F.lit("synthetic").alias("source"), F.col("id").alias("key"), made["prompt"].alias("prompt"), made["target"].alias("target"))
    return _digested(synthetic.unionByName(_sft_branches(spark, sf_dir)))


def trace_texts_whole(spark, sf_dir):
    """With the reference's cap, which is the operator's own."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("problem"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("S").alias("solution"), F.col("o_orderstatus").alias("answer"))
    return dialogue.trace_texts(rows, "key").select("key", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (source_stats, shard_stats, running_totals, running_source_totals, running_legacy_rate, encode_stats, budget_mixture, budget_rows, estimated_cut, estimated_cut_whole, quality_take, legacy_filter_cap, legacy_rate, two_field_filter_whole, holdout_split, holdout_difference, val_sample, shuffle_batches, token_offsets, pack_drop_tail, pack_resume, pack_pad_labels, pack_prompt_mask, shift_pairs, chunk_ids_rows, chunk_ids_both, row_bytes, turn_pairs, length_buckets, sample_per_source, ordered_union, sft_union, sft_union_whole, trace_texts_whole)}

_BUDGET = f"""WITH {DOCS}, {PLAN_SQL}, run AS (SELECT d.doc_id, d.source, d.n_tokens, p.target, p.cap,
  coalesce(sum(d.n_tokens) OVER w, 0) AS spent, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS kept FROM docs d LEFT JOIN plan p USING (source)
  WINDOW w AS (PARTITION BY d.source ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), chosen AS (SELECT * FROM run WHERE target IS NULL OR (spent < target AND kept < cap))"""
_SHARDED = f"""{DOCS}, sharded AS (SELECT doc_id, n_tokens, doc_id // 100 AS shard, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id DESC) AS back,
  count(*) OVER (PARTITION BY doc_id // 100) AS n FROM docs)"""
_STREAM = """stream AS (SELECT t.id, row_number() OVER (ORDER BY t.doc_id, t.place) - 1 AS pos FROM ended e, LATERAL (SELECT e.doc_id, unnest(e.ids) AS id, generate_subscripts(e.ids, 1) AS place) t)"""


def _stream_sql(end: int) -> str:
    return f"{DOCS}, ended AS (SELECT doc_id, list_append(tokens, {end}) AS ids FROM docs), {_STREAM}, packed AS (SELECT pos // {LENGTH} AS chunk_id, list(id ORDER BY pos) AS ids FROM stream GROUP BY 1)"


_PADDED = f"padded AS (SELECT chunk_id, list_concat(ids, list_transform(range({LENGTH} - len(ids)), lambda x: {PAD})) AS ids FROM packed)"

_SO_FAR = "count(*) OVER w AS docs, sum(n_tokens) OVER w::BIGINT AS tokens, min(n_tokens) OVER w AS shortest, max(n_tokens) OVER w AS longest, round(avg(n_tokens) OVER w, 6)::DOUBLE AS mean_tokens FROM docs"

SQL = {
    "running_totals": f"WITH {DOCS} SELECT doc_id, {_SO_FAR} WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)",
    "running_source_totals": f"WITH {DOCS} SELECT source, doc_id, {_SO_FAR} WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)",
    "running_legacy_rate": f"WITH {CODE_SQL}, r AS (SELECT k, examined, round(100.0 * (count(*) FILTER (NOT passes) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING))::DOUBLE / examined, 6)::DOUBLE AS rejected_percent FROM seen) SELECT * FROM r WHERE examined % 100 = 0",
    "source_stats": f"WITH {DOCS} SELECT source, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ROLLUP(source)",
    "shard_stats": f"WITH {DOCS} SELECT (doc_id // 100)::BIGINT AS shard, source, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens FROM docs WHERE source IN ('src0','src1','src2') GROUP BY 1, 2",
    "encode_stats": f"WITH {DOCS} SELECT doc_id, len(tokens)::BIGINT AS n, list_sum(tokens)::BIGINT AS total, {joined_sql('tokens')} AS digest FROM docs",
    "budget_mixture": f"{_BUDGET} SELECT source, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens, max(doc_id)::BIGINT AS last_doc FROM chosen GROUP BY source",
    "budget_rows": f"{_BUDGET} SELECT doc_id, source, n_tokens FROM chosen",
    "estimated_cut": "SELECT doc_id, source FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 300",
    "estimated_cut_whole": "SELECT doc_id, source FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 857143",
    "quality_take": "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality >= 1 ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
    "legacy_filter_cap": f"WITH {CODE_SQL}, passing AS (SELECT k, lag(examined) OVER (ORDER BY k) AS before FROM seen WHERE passes) SELECT k FROM passing WHERE before IS NULL OR before < 200",
    "legacy_rate": f"WITH {CODE_SQL} SELECT count(*)::BIGINT AS examined, count(*) FILTER (NOT passes)::BIGINT AS rejected, round(100.0 * count(*) FILTER (NOT passes)::DOUBLE / greatest(count(*), 1), 6)::DOUBLE AS rejected_percent FROM seen",
    "two_field_filter_whole": "WITH c AS (SELECT conv_id * 1000 + turn AS key, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS role, text FROM conversations) SELECT key, md5('Problem: ' || role || chr(10) || 'Solution: ' || text) AS digest FROM c WHERE role <> '' AND text <> '' ORDER BY key LIMIT 50000",
    "holdout_split": f"WITH {_SHARDED} SELECT doc_id, shard::BIGINT AS shard, back <= greatest(1, floor(n * 0.05::DOUBLE)) AS held_out FROM sharded",
    "holdout_difference": f"WITH {_SHARDED} SELECT doc_id FROM sharded WHERE back > greatest(1, floor(n * 0.05::DOUBLE))",
    "val_sample": f"WITH {_SHARDED}, drawn AS (SELECT doc_id, n_tokens FROM sharded WHERE back <= greatest(1, floor(n * 0.2::DOUBLE)) ORDER BY md5('7:' || doc_id), doc_id LIMIT 100) SELECT doc_id, n_tokens FROM drawn WHERE n_tokens >= 1000",
    "shuffle_batches": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY substr(md5('11:' || doc_id), 1, 15), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, (pos // 16)::BIGINT AS batch_id, (pos % 16)::BIGINT AS place FROM r WHERE pos < n // 16 * 16",
    "token_offsets": f"WITH {DOCS} SELECT doc_id, coalesce(sum(n_tokens + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM docs",
    "pack_drop_tail": f"WITH {_stream_sql(EOS)} SELECT chunk_id::BIGINT AS chunk_id, len(ids)::BIGINT AS n, {joined_sql('ids')} AS digest FROM packed WHERE len(ids) = {LENGTH}",
    "pack_resume": f"WITH {_stream_sql(0)} SELECT chunk_id::BIGINT AS chunk_id, len(ids)::BIGINT AS n, {joined_sql('ids')} AS digest FROM packed WHERE len(ids) = {LENGTH} AND chunk_id >= 100",
    "pack_pad_labels": f"WITH {_stream_sql(EOS)}, {_PADDED} SELECT chunk_id::BIGINT AS chunk_id, len(ids)::BIGINT AS n, {joined_sql('ids')} AS digest, {joined_sql(f'list_transform(ids, lambda i: CASE WHEN i = {PAD} THEN -100 ELSE i END)')} AS labels FROM padded",
    "pack_prompt_mask": f"""WITH {PAIRS}, coded AS (SELECT key, list_transform(string_split(question, ''), lambda c: CASE WHEN ascii(c) < 128 THEN ascii(c) ELSE 63 END) AS p, list_append(list_transform(string_split(answer, ''), lambda c: CASE WHEN ascii(c) < 128 THEN ascii(c) ELSE 63 END), {EOS}) AS t FROM pairs),
     both_ids AS (SELECT key, list_concat(p, t) AS ids, list_concat(list_transform(p, lambda x: -100), t) AS labels FROM coded),
     stream AS (SELECT t.id, t.label, row_number() OVER (ORDER BY t.key, t.place) - 1 AS pos FROM both_ids b, LATERAL (SELECT b.key, unnest(b.ids) AS id, unnest(b.labels) AS label, generate_subscripts(b.ids, 1) AS place) t),
     packed AS (SELECT pos // {LENGTH} AS chunk_id, list(id ORDER BY pos) AS ids, list(label ORDER BY pos) AS labels FROM stream GROUP BY 1)
     SELECT chunk_id::BIGINT AS chunk_id, {LENGTH}::BIGINT AS n, {joined_sql(f'list_concat(ids, list_transform(range({LENGTH} - len(ids)), lambda x: {PAD}))')} AS digest, {joined_sql(f'list_concat(labels, list_transform(range({LENGTH} - len(labels)), lambda x: -100))')} AS labels FROM packed""",
    "shift_pairs": f"WITH {_stream_sql(EOS)} SELECT chunk_id::BIGINT AS chunk_id, {joined_sql(f'list_slice(ids, 1, {LENGTH - 1})')} AS inputs, {joined_sql(f'list_slice(ids, 2, {LENGTH})')} AS labels FROM packed WHERE len(ids) = {LENGTH}",
    "chunk_ids_rows": f"WITH {DOCS} SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 77)::BIGINT AS chunk_id FROM docs",
    "chunk_ids_both": f"""WITH RECURSIVE {DOCS}, sized AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, floor((2 * n_tokens + length(source) + 24) * 1.3::DOUBLE)::BIGINT AS b FROM docs),
     cut AS (SELECT rn, doc_id, 0::BIGINT AS chunk_id, 1::BIGINT AS n, b AS total FROM sized WHERE rn = 1 UNION ALL
      SELECT s.rn, s.doc_id, CASE WHEN c.n >= 10 OR c.total >= 40000 THEN c.chunk_id + 1 ELSE c.chunk_id END, CASE WHEN c.n >= 10 OR c.total >= 40000 THEN 1 ELSE c.n + 1 END, CASE WHEN c.n >= 10 OR c.total >= 40000 THEN s.b ELSE c.total + s.b END FROM cut c JOIN sized s ON s.rn = c.rn + 1)
     SELECT doc_id, chunk_id FROM cut""",
    "row_bytes": f"WITH {DOCS} SELECT doc_id, floor((2 * n_tokens + length(source) + 24) * 1.3::DOUBLE)::BIGINT AS bytes FROM docs",
    "turn_pairs": f"WITH {PAIRS} SELECT conv_id, turn, md5(question || '|' || answer) AS digest FROM pairs",
    "length_buckets": f"WITH {DOCS}, b(bucket) AS (VALUES (1024), (2048), (4096), (8192), (16384)), m AS (SELECT doc_id, bucket::BIGINT AS bucket, n_tokens, row_number() OVER (PARTITION BY bucket ORDER BY md5('3:' || doc_id), doc_id) AS r FROM docs JOIN b ON n_tokens BETWEEN floor(0.9 * bucket) AND floor(1.1 * bucket)) SELECT doc_id, bucket, n_tokens FROM m WHERE r <= 5",
    "sample_per_source": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5",
    "ordered_union": "SELECT doc_id, source, CASE source WHEN 'src2' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END::BIGINT AS source_rank FROM documents WHERE source IN ('src0', 'src1', 'src2')",
    "sft_union": f"""WITH {PAIRS}, o AS (SELECT o_orderkey::BIGINT AS key, o_orderstatus AS st FROM orders),
     a AS (SELECT 'alpaca' AS source, key, 'Instruction: Status of ' || key || chr(10) || CASE WHEN key % 20 = 0 THEN '' ELSE 'Input: short' || chr(10) END || 'Response:' AS prompt, ' ' || st AS target FROM o WHERE key % 30 <> 0),
     t AS (SELECT 'openr1' AS source, key, 'Problem: P' || key || chr(10) || 'Solution: <REASON>' AS prompt, 'S</REASON>' || chr(10) || '<ANSWER>' || st || '</ANSWER>' AS target FROM o WHERE key % 40 <> 0 ORDER BY key LIMIT 50000),
     d AS (SELECT 'physics' AS source, key, '[Physics: general] ' || question || chr(10) || 'Answer: <REASON>' AS prompt, answer || '</REASON>' || chr(10) || '<ANSWER>Done</ANSWER>' AS target FROM pairs ORDER BY key LIMIT 30000)
     SELECT source, key, md5(prompt) AS prompt, md5(target) AS target FROM (SELECT * FROM a UNION ALL SELECT * FROM t UNION ALL SELECT * FROM d)""",
    "trace_texts_whole": "WITH f AS (SELECT o_orderkey::BIGINT AS key, o_orderstatus AS st FROM orders ORDER BY o_orderkey LIMIT 50000) SELECT key, md5('Problem: P' || key || chr(10) || chr(10) || 'Solution:' || chr(10) || 'S' || chr(10) || chr(10) || 'Answer: ' || st) AS digest FROM f WHERE key % 3 <> 0",
}
