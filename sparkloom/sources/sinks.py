"""Writers: token chunks, manifests, logs. Every write goes through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_chunks(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Zstandard Parquet with files of at most rows_per_file rows."""
    df.select("source", "text", "tokens", "n_tokens").write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_observed(df: DataFrame, path: str, rows_per_file: int = 100_000) -> dict[str, int]:
    """Writes chunks and returns docs and tokens, counted while the rows go by."""
    seen = Observation("totals")
    write_chunks(df.observe(seen, F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), path, rows_per_file)
    return seen.get


def write_with_totals(df: DataFrame, path: str, sources: list[str], rows_per_file: int = 100_000) -> list[tuple[str, int, int]]:
    """Writes chunks and returns (source, docs, tokens) of the sources named, and of all others under the empty name where there are any, counted while the rows go by."""
    seen = Observation("totals by source")
    named = [F.coalesce(F.col("source") == s, F.lit(False)) for s in sources]
    other = ~F.coalesce(F.col("source").isin(sources), F.lit(False))
    counts = [c for i, own in enumerate([*named, other]) for c in (F.count_if(own).alias(f"docs{i}"), F.coalesce(F.sum(F.when(own, F.col("n_tokens").cast("bigint"))), F.lit(0)).alias(f"tokens{i}"))]
    write_chunks(df.observe(seen, *counts), path, rows_per_file)
    got = seen.get
    rows = [(s, got[f"docs{i}"], got[f"tokens{i}"]) for i, s in enumerate([*sources, ""])]
    return rows if rows[-1][1] else rows[:-1]


def write_numbered_chunks(df: DataFrame, path: str, chunk: str = "chunk_id") -> None:
    """A folder for each chunk id, as exact chunking gives them."""
    df.repartition(chunk).write.option("compression", "zstd").partitionBy(chunk).parquet(path)


def manifest(df: DataFrame, plan: dict[str, int], ratios: dict[str, float] | None = None, rows_per_file: int | None = None) -> DataFrame:
    """One row with one JSON text: documents, tokens and (under `means`) mean tokens by source and in all, the plan, the shares it was made by, and how many chunks
    of rows_per_file rows there are at least."""
    mean = lambda: (F.col("tokens") / F.greatest(F.col("docs"), F.lit(1))).alias("mean_tokens")
    stats = df.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = stats.agg(F.sort_array(F.collect_list(F.struct("source", "docs", "tokens"))).alias("sources"), F.sort_array(F.collect_list(F.struct("source", mean()))).alias("means"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    literal = lambda d, kind: F.map_from_arrays(F.array(*[F.lit(s) for s in d]), F.array(*[F.lit(kind(v)) for v in d.values()])) if d else F.lit(None)
    chunks = F.ceil(F.col("docs") / rows_per_file) if rows_per_file else F.lit(None)
    return rows.select(F.to_json(F.struct("sources", "docs", "tokens", "means", mean(), chunks.alias("chunks"), literal(plan, int).alias("plan"), literal(ratios, float).alias("ratios"))).alias("manifest"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_examples(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder of JSON lines for each split."""
    df.write.partitionBy(split).json(path)


def write_report(judged: DataFrame, path: str) -> None:
    """An evaluation: its rows, and beside them its totals. Rows are not nested in the totals, as they grow with the table."""
    from sparkloom.operators.judging import evaluation_summary

    judged.write.json(f"{path.rstrip('/')}/rows")
    evaluation_summary(judged).coalesce(1).write.json(f"{path.rstrip('/')}/totals")
