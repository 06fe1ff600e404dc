"""Queries for what goes by stored or computed places: resumed packing, hold-out by place, shuffles by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.tokens import encode_chars
from sparkloom.operators import corpus, intervals, permutation
from sparkloom.plans.corpus_queries import SQL as CORPUS_SQL
from sparkloom.plans.corpus_queries import DOCS, LENGTH, _packed, _sharded, encoded
from sparkloom.session import scratch, table
from sparkloom.sources import chunks, positions


def pack_resume_indexed(spark, sf_dir):
    """pack_resume from files with an index, of which only those from its first sequence on are read."""
    path = scratch(spark, "positioned")
    docs = encoded(spark, sf_dir, False).select("doc_id", "text", "n_tokens")
    positions.write_positioned(docs, path, "doc_id", encode_chars(F.col("text")), n_ids="n_tokens")
    return _packed(positions.resumed(spark, path, LENGTH, None, 100))


def _shards(spark, sf_dir):
    """Documents in a file for each hundred of ids, in the order of ids, read with their places."""
    path = scratch(spark, "shards")
    rows = _sharded(spark, sf_dir).select("doc_id", "source", "n_tokens", F.col("shard").alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").write.partitionBy("file").parquet(path)
    return spark.read.parquet(path).select("doc_id", "source", F.col("file").cast("long").alias("file"), F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row_index"))


def holdout_by_place(spark, sf_dir):
    got = corpus.holdout_by_place(_shards(spark, sf_dir), 0.05)
    return got.select("doc_id", F.col("file").alias("shard"), "held_out")


def holdout_of_sources(spark, sf_dir):
    """The last fifth of each file's rows of some sources."""
    got = corpus.holdout_by_place(_shards(spark, sf_dir), 0.2, chosen=F.col("source").isin("src0", "src1", "src2", "src3"))
    return got.select("doc_id", F.col("file").alias("shard"), "held_out")


def _placed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.with_position(docs, "doc_id"), docs.count()


def epoch_batches(spark, sf_dir):
    rows, n = _placed(spark, sf_dir)
    return permutation.epoch_batches(rows, n, 16, 11, epoch=3).select("doc_id", "batch_id", "place")


def epoch_sample(spark, sf_dir):
    """A tenth of the documents, picked by their places in a shuffle."""
    rows, n = _placed(spark, sf_dir)
    return permutation.sample(rows, n, n // 10, 5).select("doc_id", "source")


def length_ranges(spark, sf_dir):
    """Documents by overlapping ranges of length, which come from a table."""
    k = F.col("n_nationkey").cast("bigint")
    ranges = table(spark, sf_dir, "nation").select(k.alias("range_id"), (k * k * 20).alias("low"), (k * k * 20 + k % 7 * 150 * (1 + k)).alias("high"))
    docs = encoded(spark, sf_dir, False).select("doc_id", "n_tokens")
    return intervals.in_intervals(docs, "n_tokens", ranges, "low", "high").select("doc_id", "range_id")


def written_chunks(spark, sf_dir):
    """Totals by source of the files that a manifest of written chunks names."""
    path = scratch(spark, "chunks")
    rows = encoded(spark, sf_dir, False).select("doc_id", "source", F.col("n_tokens").cast("int").alias("n_tokens"))
    chunks.write_token_chunks(rows, path, rows=300, size=1 << 20)
    back = chunks.read_token_chunks(spark, path, rows.schema)
    return back.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").cast("bigint").alias("tokens"))


QUERIES = {f.__name__: f for f in (written_chunks, length_ranges, pack_resume_indexed, holdout_by_place, holdout_of_sources, epoch_batches, epoch_sample)}


def _permuted_sql(seed: int, epoch: int) -> str:
    """A relation `walked` of doc_id, source, n and x, the place of each document in a shuffle."""
    keys = permutation.Permutation(2, seed, epoch).keys
    mixed = lambda v, k: f"(((xor({v} * {k[0]} + {k[1]}, ({v} * {k[0]} + {k[1]}) >> 15) & {permutation.LOW31}) * {k[2]}) >> 20)"

    def rounds(source: str) -> str:
        q = f"SELECT *, x // b AS l, x % b AS r FROM {source}"
        for i, k in enumerate(keys):
            q = f"SELECT * REPLACE ({f'(l + {mixed("r", k)}) % a AS l' if i % 2 == 0 else f'(r + {mixed("l", k)}) % b AS r'}) FROM ({q})"
        return f"SELECT doc_id, source, n, a, b, l * b + r AS x FROM ({q})"

    return f"""WITH RECURSIVE p AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents),
 d AS (SELECT doc_id, source, n, floor(sqrt(n - 1))::BIGINT + 1 AS a, x FROM p), s AS (SELECT doc_id, source, n, a, (n + a - 1) // a AS b, x FROM d),
 w AS ({rounds('s')} UNION ALL {rounds('(SELECT * FROM w WHERE x >= n)')}), walked AS (SELECT * FROM w WHERE x < n)"""


SQL = {
    "written_chunks": f"WITH {DOCS} SELECT source, count(*)::BIGINT AS docs, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source",
    "length_ranges": f"WITH {DOCS}, r AS (SELECT n_nationkey::BIGINT AS range_id, n_nationkey * n_nationkey * 20 AS low, n_nationkey * n_nationkey * 20 + n_nationkey % 7 * 150 * (1 + n_nationkey) AS high FROM nation) SELECT doc_id, range_id FROM docs JOIN r ON n_tokens BETWEEN low AND high",
    "pack_resume_indexed": CORPUS_SQL["pack_resume"],
    "holdout_by_place": CORPUS_SQL["holdout_split"],
    "holdout_of_sources": "WITH s AS (SELECT doc_id, doc_id // 100 AS shard, row_number() OVER w AS back, count(*) OVER (PARTITION BY doc_id // 100) AS n FROM documents WHERE text <> '' AND source IN ('src0', 'src1', 'src2', 'src3') WINDOW w AS (PARTITION BY doc_id // 100 ORDER BY doc_id DESC)) SELECT doc_id, shard::BIGINT AS shard, back <= greatest(1, floor(n * 0.2::DOUBLE)) AS held_out FROM s",
    "epoch_batches": f"{_permuted_sql(11, 3)} SELECT doc_id, (x // 16)::BIGINT AS batch_id, (x % 16)::BIGINT AS place FROM walked WHERE x < n // 16 * 16",
    "epoch_sample": f"{_permuted_sql(5, 0)} SELECT doc_id, source FROM walked WHERE x < n // 10",
}
