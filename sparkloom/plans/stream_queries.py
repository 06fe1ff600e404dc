"""Queries that go through a stream or a tokenizer file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.bpe import encode_bpe
from sparkloom.functions.tokens import EOS
from sparkloom.plans.corpus_queries import DOCS, LENGTH, PLAN, encoded, joined, joined_sql
from sparkloom.plans.corpus_queries import SQL as CORPUS_SQL
from sparkloom.session import scratch, table
from sparkloom.streaming.state import budget_stream, packed_stream


def streamed(rows: DataFrame, key: str, label: str, make: Callable[[DataFrame], DataFrame], parts: int = 4) -> DataFrame:
    """What a stream makes of rows that come in the order of a key. A range of the key is written by many tasks, and the query run until nothing is left, before the
    next range is written: a file's time, by which Spark takes files, is not its rows' order. Null keys come first."""
    spark = rows.sparkSession
    at = scratch(spark, label)
    bounds = rows.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)])).first()[0] or []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = rows if low is None else rows.where(F.col(key) > low)
        if high is not None:
            part = part.where((F.col(key) <= high) | F.col(key).isNull()) if low is None else part.where(F.col(key) <= high)
        part.write.mode("append").parquet(f"{at}/in")
        made = make(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
        query = made.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/rows")


def stream_budget(spark, sf_dir):
    """The budget cut over documents as a stream of four triggers, equal to the batch cut."""
    rows = encoded(spark, sf_dir, False).select("doc_id", "source", "n_tokens")
    return streamed(rows, "doc_id", "stream-budget", lambda s: budget_stream(s, PLAN)).select("doc_id", "source", "n_tokens")


def stream_packed(spark, sf_dir):
    """Documents of each shard packed as a stream over four triggers, equal to packing each shard at once."""
    docs = encoded(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 100).cast("bigint").alias("shard"), "tokens")
    got = streamed(docs, "doc_id", "stream-packed", lambda s: packed_stream(s, LENGTH, EOS))
    return got.select("shard", "chunk_id", F.size("input_ids").cast("bigint").alias("n"), joined(F.col("input_ids")).alias("digest"))


def bpe_encode(spark, sf_dir):
    import public_tokenizers

    ids = encode_bpe(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", ids.alias("ids"))
    return docs.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.array_max("ids").cast("bigint").alias("greatest"))


QUERIES = {f.__name__: f for f in (stream_budget, stream_packed, bpe_encode)}
SQL = {
    "stream_budget": CORPUS_SQL["budget_rows"],
    "stream_packed": f"""WITH {DOCS}, ended AS (SELECT doc_id, doc_id // 100 AS shard, list_append(tokens, {EOS}) AS ids FROM docs),
     stream AS (SELECT t.shard, t.id, row_number() OVER (PARTITION BY t.shard ORDER BY t.doc_id, t.place) - 1 AS pos FROM ended e, LATERAL (SELECT e.doc_id, e.shard, unnest(e.ids) AS id, generate_subscripts(e.ids, 1) AS place) t),
     packed AS (SELECT shard, pos // {LENGTH} AS chunk_id, list(id ORDER BY pos) AS ids FROM stream GROUP BY 1, 2)
     SELECT shard::BIGINT AS shard, chunk_id::BIGINT AS chunk_id, len(ids)::BIGINT AS n, {joined_sql('ids')} AS digest FROM packed WHERE len(ids) = {LENGTH}""",
}
