"""Token ids as ORC: run-length-encoded id lists, row indexes and a Bloom filter on the document id.

Documents are dealt into ranges of ascending id, encoded where they lie, and written one file a range, so that files, stripes and
rows ascend by id. Each row carries its range and its start there; a range's base comes from the files' narrow columns, so a
document's position in the whole stream costs no sort of the corpus in one task. A stripe is read alone; a look-up by id prunes
stripes by their minimum, maximum and Bloom filter.

Defined cases: null text counts as empty (its row has the end id alone); null ids come first; rows that repeat an id keep the order
of their texts; an empty table gives an empty folder of files with the schema; columns besides id and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import PieceEncoder, shared_dir, table, text_groups

STRIPE_BYTES = 32 << 20
ROWS = 512  # rows that a worker holds as Python strings
FLUSH_TOKENS = 1 << 20
FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encode_range(tokenizer_path: str, end_id: int, keeps_space: bool) -> Callable:
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = PieceEncoder.shared(tokenizer_path, keeps_space)
        end = np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0

        def block(doc_ids, coded):
            nonlocal at
            n = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            stops = np.cumsum(n)
            values = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"), type=pa.int32())
            offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32))
            out = [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(at + stops - n), pa.array(n), pa.ListArray.from_arrays(offsets, values)]
            at += int(stops[-1])
            return pa.RecordBatch.from_arrays(out, ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

        for batch in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows in text_groups(texts, encoder.GROUP):
                coded, low = [ids + end for ids in encoder.encode(texts[rows])], 0
                sizes = np.cumsum([len(c) // 4 for c in coded])
                while low < len(coded):
                    high = max(low + 1, int(np.searchsorted(sizes, FLUSH_TOKENS + (sizes[low - 1] if low else 0), side="right")))
                    yield block(doc_ids[rows][low:high], coded[low:high])
                    low = high

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, keeps_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id, and writes the ids in ascending id order as ORC to path."""
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_encode_range(tokenizer_path, end_id, keeps_space), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with `start`, the number of ids of all documents before a row. Columns that aren't used aren't read."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total"))
    # One row a file: a list of files, not of documents, so the driver may hold and broadcast it.
    bases, at = [], 0
    for part, total in sorted(totals.collect()):
        bases.append((part, at))
        at += total
    base = spark.createDataFrame(bases, "part int, base long")
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the predicate reaches the ORC reader, which prunes stripes and row groups."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _digest(batches):
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(2)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        offsets = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n = np.diff(offsets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the ids that were read back."""
    return rows.select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "token-orc")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_digests(read_tokens(spark, path))
