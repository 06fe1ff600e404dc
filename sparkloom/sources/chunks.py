"""A data source that writes token chunks: files closed by rows or by estimated bytes, with a manifest of what each one holds.

    register(spark); df.write.format("token_chunks").option("rows", 100_000).option("bytes", 512 << 20).mode("append").save(path)

A task closes its file when it has that many rows or bytes. Its commit message carries each file's rows, bytes and totals by source, and the commit, once, writes
manifest.json from the messages: nothing is counted again. What attempts that failed have left isn't in the manifest, so readers take the manifest's files. The folder
must be one that Python reaches on all executors: a shared path, or a store that pyarrow knows. It must be empty, or not there.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS, BYTES = 100_000, 512 << 20
MANIFEST = "manifest.json"


@dataclass
class Chunk:
    name: str
    rows: int
    bytes: int
    docs: dict[str, int]
    tokens: dict[str, int]


@dataclass
class Chunks(WriterCommitMessage):
    files: list[Chunk] = field(default_factory=list)


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """The estimate that closes chunks, as functions.tokens.estimated_row_bytes has it; nulls count as nothing."""
    import pyarrow.compute as pc

    tokens = batch.column("n_tokens").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    source = pc.utf8_length(batch.column("source")).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return np.floor((2 * tokens + source + 24) * 1.3).astype(np.int64)


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, size: int):
        if rows < 1 or size < 1:
            raise ValueError("rows and bytes must be at least 1")
        self.path, self.rows, self.size = path.rstrip("/"), rows, size

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Chunks:
        store, folder = self._folder()
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        out, writer, now = Chunks(), None, None
        for batch in iterator:
            sizes = row_bytes(batch)
            total = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < batch.num_rows:
                if writer is None:
                    now = Chunk(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(out.files):05d}.parquet", 0, 0, {}, {})
                    writer = pq.ParquetWriter(f"{folder}/{now.name}", batch.schema, filesystem=store, compression="zstd")
                # The row that reaches a limit is the file's last.
                end = min(at + self.rows - now.rows, int(np.searchsorted(total, total[at] + self.size - now.bytes)), batch.num_rows)
                end = max(end, at + 1)
                part = batch.slice(at, end - at)
                writer.write_batch(part)
                self._count(now, part)
                now.rows, now.bytes, at = now.rows + end - at, now.bytes + int(total[end] - total[at]), end
                if now.rows >= self.rows or now.bytes >= self.size:
                    writer.close()
                    out.files.append(now)
                    writer = None
        if writer is not None:
            writer.close()
            out.files.append(now)
        return out

    @staticmethod
    def _count(chunk: Chunk, part: pa.RecordBatch) -> None:
        for source, n in zip(part.column("source").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
            chunk.docs[source or ""] = chunk.docs.get(source or "", 0) + 1
            chunk.tokens[source or ""] = chunk.tokens.get(source or "", 0) + (n or 0)

    def commit(self, messages: list[Chunks | None]) -> None:
        files = sorted((c for m in messages if m for c in m.files), key=lambda c: c.name)
        docs, tokens = Counter(), Counter()
        for c in files:
            docs.update(c.docs)
            tokens.update(c.tokens)
        told = {"files": [{"name": c.name, "rows": c.rows, "bytes": c.bytes, "docs": c.docs, "tokens": c.tokens} for c in files], "docs": docs.total(), "tokens": tokens.total(), "sources": {s: {"docs": docs[s], "tokens": tokens[s]} for s in sorted(docs)}}
        store, folder = self._folder()
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps(told).encode())

    def abort(self, messages: list[Chunks | None]) -> None:
        store, folder = self._folder()
        for c in (c for m in messages if m for c in m.files):
            store.delete_file(f"{folder}/{c.name}")


class TokenChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_chunks"

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        missing = {"source", "n_tokens"} - set(schema.names)
        if missing or overwrite:
            raise ValueError(f"missing columns: {sorted(missing)}" if missing else "chunks are appended to an empty folder; mode must be append")
        out = ChunkWriter(self.options["path"], int(self.options.get("rows", ROWS)), int(self.options.get("bytes", BYTES)))
        store, folder = out._folder()
        if store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{folder} has a manifest")
        return out


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenChunks)


def write_token_chunks(df: DataFrame, path: str, rows: int = ROWS, size: int = BYTES) -> None:
    register(df.sparkSession)
    df.write.format("token_chunks").option("rows", rows).option("bytes", size).mode("append").save(path)


def read_token_chunks(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the manifest's files."""
    from sparkloom.sources.readers import manifest_of

    told = manifest_of(spark, path)
    if told is None:
        raise FileNotFoundError(f"{path} has no manifest")
    files = [f"{path.rstrip('/')}/{f['name']}" for f in told["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
