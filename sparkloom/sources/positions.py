"""Token files that know where they are: a corpus written once in order, each row with the place of its first token, and an index of its files.

A run that resumes at some sequence reads the index, opens only files that reach into the sequences it wants, and skips row groups by the statistics of
`position`, which rises through the files. Nothing before that is read, not even lengths. Every document counts one id more than it has, its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import packing, prefix


def write_positioned(df: DataFrame, path: str, order: str, ids: str | Column = "tokens", files: int | None = None, n_ids: str | None = None, rows_per_file: int = 100_000) -> None:
    """Writes documents to path/rows with `position`, `number` (the documents before it) and `n_ids`, in the order of a key, as about so many files or
    more, and the index to path/index, which comes last: without it a folder isn't whole. Rows without ids (null) go. ids: a column's name, or an expression, which is written
    as `tokens`; n_ids: a column with how many ids there are, where there is one. With both, ids are made as rows are written, after they have been moved."""
    spark = df.sparkSession
    given = F.col(ids) if isinstance(ids, str) else ids
    size = F.size(given) if n_ids is None else F.col(n_ids)
    whole = (df.where(given.isNotNull()) if n_ids is None else df.where(size.isNotNull())).withColumn("n_ids", size.cast("long"))
    ends = prefix.running(whole, order, {"_rows": prefix.rows(), "_ids": prefix.total(F.col("n_ids") + 1)})
    placed = ends.withColumn("position", (F.col("_ids") - F.col("n_ids") - 1).cast("long")).withColumn("number", (F.col("_rows") - 1).cast("long")).drop("_rows", "_ids")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(n, "position").sortWithinPartitions("position")
    made = dealt if isinstance(ids, str) else dealt.withColumn("tokens", ids)
    made.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{path.rstrip('/')}/rows")
    written = spark.read.parquet(f"{path.rstrip('/')}/rows").select(F.col("_metadata.file_path").alias("file"), "position", "number", "n_ids")
    index = written.groupBy("file").agg(F.min("position").alias("first"), F.max(F.col("position") + F.col("n_ids") + 1).alias("last"), F.min("number").alias("number"), F.count(F.lit(1)).alias("rows"))
    index.repartitionByRange(max(1, n // 64), "first").sortWithinPartitions("first").write.parquet(f"{path.rstrip('/')}/index")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """file, first, last (where its tokens begin and end), number (the documents before it), rows."""
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def rows_between(spark: SparkSession, path: str, first: int, last: int | None = None) -> DataFrame:
    """Documents with an id at a place from `first` on and before `last`. Other files aren't opened, other row groups not read."""
    rows = f"{path.rstrip('/')}/rows"
    reach = (F.col("last") > first) & (F.lit(True) if last is None else F.col("first") < last)
    # One name a file, as for any read of files.
    files = [r.file for r in index_of(spark, path).where(reach).select("file").collect()]
    schema = spark.read.parquet(rows).schema
    if not files:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(*files)
    # The document that holds `first` begins at the greatest position up to it: one look at the first file's narrow columns, by which the scan can skip row groups.
    begins = found.where(F.col("position") <= first).agg(F.max("position")).first()[0]
    found = found.where(F.col("position") >= (first if begins is None else begins))
    return found if last is None else found.where(F.col("position") < last)


def resumed(spark: SparkSession, path: str, length: int, end_id: int | None, skip: int, take: int | None = None, ids: str = "tokens") -> DataFrame:
    """chunk_id, input_ids of the full sequences from number `skip` on (`take` of them at most), as packing.pack_drop_tail gives them for the whole corpus. No end id counts as 0."""
    last = None if take is None else (skip + take) * length
    rows = rows_between(spark, path, skip * length, last)
    ended = rows.select("position", (F.col("n_ids") + 1).cast("int").alias("_n"), F.concat(F.col(ids), F.array(F.lit(end_id or 0))).alias("input_ids"))
    return packing.cut(ended, length, ["input_ids"], skip, None if take is None else skip + take - 1).where(F.size("input_ids") == length)
