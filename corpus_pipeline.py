"""The corpus pipeline: language ID, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next stage's docs. All but the last
return the columns of documents, with whatever extra columns came in.

language: rows whose text has no language (null, or no letter) go; all others stay as they are.
near_dedup: of each group of near duplicates the row with the smallest doc_id stays, and rows that repeat that id.
secrets: every row stays; each secret in its text is replaced by its kind in brackets, and n_chars follows the new text.
packing: one row a piece of a document in a sequence of at most 1,024 tokens.

Defined cases, for every stage: an empty table gives no row; texts of any length are read whole. Null and empty texts have no language and go at once; a stage that is given one by
itself keeps it (near_dedup: it is like nothing; secrets: it has none; packing: its end id alone). Rows that repeat an id are documents of their own: of equal texts under one
id all stay, as none is smaller than the other; a null id is never the smaller one and its row stays. A null lang teaches nothing, and where no row has one no language is known and all rows go; null source or
n_chars decide nothing, and n_chars is counted anew when secrets are replaced. Columns besides those of documents go along, but not into pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language, near_dedup, packing, secrets
from sparkloom.llm.common import staged, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.fit_documents(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, near_dedup.Settings(words=5))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", by_language), ("near_dedup", without_near_copies), ("secrets", without_secrets), ("packing", packed)]

# A fitted language model and a tokenizer library are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
