"""Readers: JSON lines, Parquet shards, manifests, staged copies, generated problems. A source that fails fails the job; none is skipped in silence."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.arithmetic import problem

WORD_PROBLEMS = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
COMPETITION = T.StructType([T.StructField(c, T.StringType()) for c in ("problem", "solution", "level", "type")])
TOKEN_ROWS = T.StructType([T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())])


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A record a line; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing text fields are empty."""
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def word_problems(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(json_lines(spark, path, WORD_PROBLEMS))


def competition_problems(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(json_lines(spark, path, COMPETITION))


def shard_paths(names: list[str], data_dir: str = "data/train/") -> list[str]:
    """Parquet files at the root, sorted; if there are none, those under data_dir."""
    parquet = [n for n in names if n.endswith(".parquet")]
    root = sorted(n for n in parquet if "/" not in n)
    return root or sorted(n for n in parquet if n.startswith(data_dir))


def token_shards(spark: SparkSession, paths: list[str], most: int | None = None) -> DataFrame:
    """Rows of the first `most` shards, with the file each is from (`shard`) and its place there (`row_index`)."""
    chosen = paths[:most] if most is not None else paths
    if not chosen:
        raise FileNotFoundError("no Parquet shards")
    df = spark.read.parquet(*chosen)
    return df.select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_index"))


def first_shards(spark: SparkSession, paths: list[str], most: int, score: str, least: int, seed: int, key: str, n: int) -> DataFrame:
    """n rows that score at least `least` from the first shards, in seeded order."""
    from sparkloom.operators.mixture import quality_take

    return quality_take(spark.read.parquet(*paths[:most]), score, least, n, seed, key)


def quality_shard_texts(spark: SparkSession, paths: list[str], n: int, key: str, most: int = 4, score: str = "quality_label", least: int = 3, seed: int = 42) -> DataFrame:
    """first_shards with the defaults that the corpus is built with."""
    return first_shards(spark, paths, most, score, least, seed, key, n)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def manifest_of(spark: SparkSession, folder: str) -> dict | None:
    """The manifest at the folder's root, else that under data/train, else None."""
    for name in ("manifest.json", "data/train/manifest.json"):
        path = f"{folder.rstrip('/')}/{name}"
        if _exists(spark, path):
            return json.loads(spark.read.text(path, wholetext=True).first()[0])
    return None


def prefetched(df: DataFrame, path: str) -> DataFrame:
    """The rows as staged at path: written once, and reused by whoever comes later. A copy counts as whole by its commit mark alone, so what a
    broken write left is written again."""
    spark = df.sparkSession
    if not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_count(spark: SparkSession, path: str) -> int:
    """From the footers: no column is read."""
    return spark.read.parquet(path).count()


def generated_problems(spark: SparkSession, n: int, seed: int = 42, digits: int = 3) -> DataFrame:
    """source, id, text of n arithmetic problems that the seed determines."""
    rows = spark.range(n).select("id", problem(F.col("id"), seed, digits).alias("p"))
    return rows.select(F.lit("synthetic").alias("source"), "id", F.concat(F.lit("Question: "), F.col("p.question"), F.lit("\nAnswer: "), F.col("p.answer")).alias("text"))
